"""Secrets in texts: known patterns and windows of high entropy, in DataFrame operations only.

Candidate strings are found by regular expressions whose places follow from the lengths of the
matches and of the text between them. Runs of token characters are then scanned by a sliding
window: its character counts change by one character in and one out per step, and so does
the sum from which the Shannon entropy follows. The threshold depends on the run's
character class; an allow-list suppresses runs that are no secrets. Where a run as a whole is none, its
parts between slashes are judged by themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.llm.common import let, need, stored

# The patterns and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
#: A run is its own longest match, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits per character that some window must reach, by the class of the run or part.
HEX_BITS, TOKEN_BITS = 3.0, 3.8
#: Runs of token characters; `=` ends them, as padding or because a value follows.
RUN = f"[A-Za-z0-9+/_-]{{{WINDOW},}}={{0,2}}"
#: Runs that are no secrets: words (of one case or with capitals in front, without six consonants in a row) joined by
#: signs, numbers, UUIDs, and what names itself an example.
ALLOWED = (
    r"^(?!.*(?i:[bcdfghjklmnpqrstvwxz]{6}))(?:[+/_=-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?![A-Za-z])))*+[+/_=-]*+$",
    r"^[0-9+/_=-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i:example|sample|placeholder|changeme)",
    r"(?i:0123456789|abcdefghij)",
)


def _found(text: Column, kind: int, pattern: str) -> Column:
    """(kind, number, gap before, match) of every leftmost match, in order."""

    def places(both: Column) -> Column:
        return F.transform(
            both["m"],
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("number"), F.char_length(both["gaps"][i]).alias("gap"), m.alias("match")
            ),
        )

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")
    )
    return F.when(text.rlike(pattern), let(both, places))


def peak(run: Column, bits: Column, window: int = WINDOW) -> Column:
    """First start and last end (null if none) of the windows whose entropy reaches `bits`.

    `run` holds characters of ALPHABET only and is at least one window long.
    """
    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count)).otherwise(0.0)

    def scan(codes: Column) -> Column:
        head = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda c: F.size(F.filter(head, lambda x: x == c)))
        # entropy = log2(window) - sum / window
        limit = (F.lit(math.log2(window)) - bits) * window + 1e-9
        none = F.lit(None).cast("int")

        def seen(sum: Column, at: Column, first: Column, last: Column) -> tuple[Column, Column]:
            high = sum <= limit
            return F.when(high, F.coalesce(first, at)).otherwise(first), F.when(high, at + window).otherwise(last)

        def start(counts: Column) -> Column:
            sum = F.aggregate(counts, F.lit(0.0), lambda s, c: s + weight(c))

            def state(sum: Column) -> Column:
                first, last = seen(sum, F.lit(0), none, none)
                return F.struct(counts.alias("counts"), sum.alias("sum"), first.alias("first"), last.alias("last"))

            return let(sum, state)

        def step(state: Column, i: Column) -> Column:
            into, out = codes[i], codes[i - window]
            a, b = state["counts"][into - 1], state["counts"][out - 1]
            change = F.when(into == out, 0.0).otherwise(weight(a + 1) - weight(a) + weight(b - 1) - weight(b))
            counts = F.when(into == out, state["counts"]).otherwise(
                F.transform(
                    state["counts"],
                    lambda x, j: F.when(j == into - 1, x + 1).when(j == out - 1, x - 1).otherwise(x),
                )
            )

            def moved(sum: Column) -> Column:
                first, last = seen(sum, (i - window + 1), state["first"], state["last"])
                return F.struct(counts.alias("counts"), sum.alias("sum"), first.alias("first"), last.alias("last"))

            return let(state["sum"] + change, moved)

        size = F.size(codes)
        moves = F.when(size > window, F.sequence(F.lit(window), size - 1)).otherwise(F.array().cast("array<int>"))
        end = F.aggregate(moves, let(counts, start), step)
        return let(end, lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last")))

    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(F.filter(codes, lambda c: c > 0), scan)


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    allowed: tuple[str, ...] = ALLOWED,
    hex_bits: float = HEX_BITS,
    token_bits: float = TOKEN_BITS,
) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans for every row.

    A span is kind:start:end in code points, the end excluded, of a whole match; spans are
    sorted by start, then kind, and joined by commas. Null and empty texts, and texts without
    secrets, have no spans: an empty string, and its SHA-256. Rows with the same id are
    scanned each by itself. Texts never leave their scan; a text's spans meet in one row. An
    empty table gives no rows; other columns are not read.
    """
    need(docs, id, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, RUN)
    parts = [F.coalesce(_found(whole, k, p), F.array().cast("array<struct<kind:int,number:int,gap:int,match:string>>")) for k, p in enumerate(patterns)]
    rows = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.concat(*parts).alias("found")),
        "found",
    )
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("number")
    size = F.char_length("match")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(before)).withColumn("start", F.col("end") - size)
    value = F.char_length(F.regexp_extract("match", ASSIGN, 2))
    placed = placed.where((F.col("kind") != 0) | (value >= ASSIGN_VALUE))

    # each run, and where it has slashes its parts with their places
    def pieces(parts: Column) -> Column:
        def place(part: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, x: n + F.char_length(x) + 1)
            return F.struct(F.lit(1).alias("level"), before.alias("shift"), part.alias("text"))

        return F.transform(parts, place)

    whole_run = F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("shift"), F.col("match").alias("text")))
    parts_too = F.when(F.col("match").contains("/"), F.concat(whole_run, let(F.split("match", "/"), pieces))).otherwise(whole_run)
    candidates = (
        placed.where("kind = 3").select("row", "kind", F.col("start").alias("run"), F.explode(parts_too).alias("c"))
        .select("row", "kind", "run", "c.level", (F.col("run") + F.col("c.shift")).alias("start"), "c.text")
        .where(F.char_length("text") >= WINDOW)
    )
    suppressed = F.lit(False)
    for pattern in allowed:
        suppressed |= F.col("text").rlike(pattern)
    bits = F.when(F.col("text").rlike("^[0-9a-fA-F]+$"), F.lit(hex_bits)).otherwise(F.lit(token_bits))
    base = placed.where("kind < 3").select("row", "kind", "start", "end")
    extra = (
        candidates.where(~suppressed)
        .select("row", "kind", "run", "level", "start", peak(F.col("text"), bits).alias("p"))
        .where("p.first IS NOT NULL")
        .withColumn("first_level", F.min("level").over(Window.partitionBy("row", "run")))
        .where("level = first_level")
        .select("row", "kind", (F.col("start") + F.col("p.first")).alias("start"), (F.col("start") + F.col("p.last")).alias("end"))
    )
    spans = base.union(extra).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))

    def joined(s: Column) -> Column:
        name = F.array(*map(F.lit, KINDS))
        return F.array_join(
            F.transform(s, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.select("row", "id").join(spans, "row", "left").withColumn("s", F.coalesce("s", none)).select(
        F.col("id").alias(id),
        count(0), count(1), count(2),
        F.sha2(joined(F.filter("s", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )
