"""Chat formatting from event logs.

A conversation is what its log of events says: messages are opened, streamed as deltas,
edited, and regenerated. The log is folded into final messages, which are rendered with a
template, one row per turn; a conversation's text is its rows in order. The template can be
read back without loss.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pharmasift.llm.common import let, need

# The template.
ROLES = ("system", "user", "assistant")
TURN, END = "### ", "</turn>"
TRAINED = "assistant"

_HEADER = re.compile(re.escape(TURN) + r"((?:[^\\:]|\\.)*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """No control string is left in the text: a backslash breaks every `##` and `</turn>`."""
    for plain, broken in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(broken))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: DataFrame) -> DataFrame:
    """conv_id, position, role, text of the final messages.

    Events have conv_id, message (names a message within its conversation), seq (any sortable
    type), kind, role and text. `open` starts a message, `delta` appends, `edit` replaces all text so
    far, `regenerate` empties the message and drops the messages opened after it so far.
    Events delivered twice count once; other kinds say nothing. The log is partitioned by conversation and
    message and sorted by sequence, so a hot conversation is folded by many tasks;
    only the sequences of openings and regenerations meet per conversation, to see which messages were dropped.
    Null conversations, messages and roles are values like any other (a null role folds to an empty one), null texts say
    nothing, an empty log gives no rows, and other columns are not read.
    """
    need(events, "conv_id", "message", "seq", "kind", "role", "text")
    entry = F.struct("seq", "kind", "role", "text")
    logs = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(entry)).alias("log"))

    def last(log: Column) -> Column:
        resets = F.filter(log, lambda e: e["kind"].isin("edit", "regenerate"))
        start = F.when(F.size(resets) > 0, F.element_at(resets, -1)["seq"])
        said = F.filter(log, lambda e: e["kind"].isin("delta", "edit", "regenerate") & (start.isNull() | (e["seq"] >= start)))
        roles = F.filter(log, lambda e: e["role"].isNotNull())
        return F.struct(
            log[0]["seq"].alias("position"),
            F.coalesce(F.when(F.size(roles) > 0, roles[0]["role"]), F.lit("")).alias("role"),
            F.array_join(F.transform(said, lambda e: F.when(e["kind"] != "regenerate", e["text"])), "").alias("text"),
        )

    messages = logs.select("conv_id", "message", let(F.col("log"), last).alias("m")).select("conv_id", "message", "m.*")
    if not events.where("kind = 'regenerate'").isEmpty():
        # without texts: where each message was opened, and when it was last regenerated
        first = F.min(F.struct("seq"))["seq"].alias("position")
        again = F.max(F.when(F.col("kind") == "regenerate", F.struct("seq")))["seq"].alias("again")
        places = events.groupBy("conv_id", "message").agg(first, again)
        earlier = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        dropped = places.withColumn("latest", F.max("again").over(earlier)).where("latest > position").select(
            F.col("conv_id").alias("_conv"), F.col("message").alias("_message")
        )
        same = messages["conv_id"].eqNullSafe(dropped["_conv"]) & messages["message"].eqNullSafe(dropped["_message"])
        messages = messages.join(dropped, same, "left_anti")
    return messages.drop("message")


def render(messages: DataFrame) -> DataFrame:
    """Adds formatted and, for trained turns, the loss mask [loss_start, loss_end) in code points of it.

    The mask covers the (escaped) text of assistant turns and nothing else. Null role and text count as empty;
    repeated rows are turns of their own, an empty table stays empty, and columns of these three names are replaced.
    """
    need(messages, "role", "text")
    role = F.coalesce("role", F.lit(""))
    other = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
    head = F.concat(F.lit(TURN), F.when(role.isin(*ROLES), F.initcap(role)).otherwise(other), F.lit(": "))
    body = escape(F.coalesce("text", F.lit("")))
    trained = role == TRAINED
    return messages.withColumns(
        {
            "formatted": F.concat(head, body, F.lit(END + "\n")),
            "loss_start": F.when(trained, F.char_length(head)),
            "loss_end": F.when(trained, F.char_length(head) + F.char_length(body)),
        }
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        end = formatted.find(END + "\n", at)
        if not head or end < 0:
            raise ValueError("not a formatted conversation")
        label = head[1]
        role = unescape(label[1:]) if label.startswith("=") else label.lower()
        turns.append((role, unescape(formatted[head.end() : end])))
        at = end + len(END) + 1
    return turns


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted rows and loss masks alone.

    A digest runs over a conversation in order, so its rows stream through one task; only hash states
    and one row are held, however long the conversation is. A null conversation is one of its own; an empty
    table gives no rows; other columns are not read.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    rows = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "formatted", "loss_start", "loss_end")

    def digest(batches):
        conv, state, key = None, None, None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def batch_of(found):
            columns = list(zip(*found))
            arrays = [pa.array(columns[0], key), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def closed():
            turns, said, chars, loss, size = state
            return conv, turns, said.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            key, found = batch.schema.field(0).type, []
            for c, text, a, b in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        found.append(closed())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    masked = unescape(text[a:b])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(text)
            if found:
                yield batch_of(found)
        if state is not None:
            yield batch_of([closed()])

    names = ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))]
    return rows.mapInArrow(digest, f"conv_id {kind}, {DIGEST}")


def log_of(conversations: DataFrame) -> DataFrame:
    """The rows of a table (conv_id, turn, role, text) as a log of events that folds to them.

    Each message is opened and streamed in two deltas. By a hash of the turn, a third of the messages
    begins with a wrong draft that is edited into the final text, another third with one that is
    regenerated. Rows that share conversation and turn are messages of their own, in the order of the
    table; null texts stream nothing, an empty table gives no events, and other columns are not read.
    """
    need(conversations, "conv_id", "turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    half = (F.char_length("text") / 2).cast("int")
    nothing = F.lit(None).cast("string")

    def event(kind: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    start = event("open", F.col("role"), nothing)
    draft = event("delta", nothing, F.concat(F.lit("draft: "), F.reverse(F.coalesce("text", F.lit("")))))
    deltas = (event("delta", nothing, F.left("text", half)), event("delta", nothing, F.substr(F.col("text"), half + 1)))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    steps = (
        F.when(way == 0, F.array(start, *deltas))
        .when(way == 1, F.array(start, draft, event("edit", nothing, F.coalesce("text", F.lit("")))))
        .otherwise(F.array(start, draft, event("regenerate", nothing, nothing), *deltas))
    )
    return rows.select("conv_id", "turn", "message", F.posexplode(steps).alias("step", "e")).select(
        "conv_id", "message", F.struct("turn", "message", "step").alias("seq"), "e.kind", "e.role", "e.text"
    )


def format_log(events: DataFrame) -> DataFrame:
    """conv_id, position, role, text, formatted, loss_start, loss_end: one row per final turn."""
    return render(fold(events))
