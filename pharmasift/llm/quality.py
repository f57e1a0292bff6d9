"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document, several per kind of defect. No truth is
assumed: expectation-maximisation over the counts of their vote patterns estimates how often
each labeller is right, and so the probability of a defect given the votes. These posterior
labels then train a linear scorer over hashed features, which decides.

The labellers for toxic texts look for words and word beginnings that occur much more often in
documents labelled toxic; that list is learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
import math
import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need, small, stored

#: Labelled rows the toxic word list is learned from, and rows the scorer is trained on, in expectation.
LABELLED_ROWS = 20_000
TRAIN_ROWS = 6_000
FEATURES = 1 << 18
#: Least ratio of a term's rates in toxic and other texts, least number of toxic texts that have it, least
#: likelihood-ratio statistic (twice the log-likelihood gained by separate rates), most terms.
TERM_RATIO, TERM_DOCS, TERM_GAIN, TERMS = 8.0, 3, 30.0, 2000
#: Log-likelihood ratio from which a list of terms votes for toxic.
TOXIC_EVIDENCE = 2.5
REJECT = 0.5

FAMILIES = {
    "shouting": ("upper_letters", "upper_words", "bangs"),
    "symbols": ("symbol_share", "symbol_words", "symbol_runs"),
    "listing": ("bars", "barred_lines", "bar_pairs"),
    "repetition": ("few_words", "echoes", "compressible", "same_sentences"),
    "toxic": ("toxic_words", "toxic_starts", "toxic_stems"),
}
LABELLERS = [name for names in FAMILIES.values() for name in names]
FAMILY_OF = [family for family, names in FAMILIES.items() for _ in names]
#: How each toxic labeller reads a word: whole, or its first letters.
TERM_SIZES = (None, 5, 6)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(rb"[.!?\n|]+")
_UPPER_WORD = re.compile(rb"(?<![^\s])[A-Z\x80-\xff]{2,}(?![a-z])")
_RUN = re.compile(rb"([#%&*$@^~+=<>])\1\1")
_MARKED = re.compile(rb"[#%&*$@^~+=<>](?=\s|$)")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"#%&*$@^~+=<>"
_SPACES = b" \t\n\v\f\r"


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def starts(words, size: int | None):
    return words if size is None else [w[:size] for w in words if len(w) >= size]


def spoken(text: str) -> tuple[list[str], int]:
    """Lower-case words, and how many repeat the word before them.

    A word repeated on the spot stays only once, as that says nothing new.
    """
    words = _WORD.findall(text.lower())
    echoes = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    if echoes:
        words = [w for w, before in zip(words, ["", *words]) if w != before]
    return words, echoes


class Words:
    """The words of a text, read whole and by their first letters; counted only where needed."""

    def __init__(self, words: list[str]):
        self.words, self.n = words, len(words)
        self.known = set(words)
        self.starts = Counter([w[:5] for w in words])

    def counts(self, terms, size: int | None) -> dict[str, int]:
        """How often each of the terms occurs."""
        if size == 5:
            return {t: self.starts[t] for t in terms if t in self.starts}
        if size is None:
            return {t: self.words.count(t) for t in terms if t in self.known}
        hits = terms & {w[:size] for w in self.known}
        return Counter(w[:size] for w in self.words if w[:size] in hits) if hits else {}


@dataclass
class Terms:
    """Per reading of words: log ratio of each term, and the summed excess rate of all of them."""

    weights: list[dict[str, float]] = field(default_factory=lambda: [{} for _ in TERM_SIZES])
    excess: list[float] = field(default_factory=lambda: [0.0 for _ in TERM_SIZES])

    def evidence(self, words: Words, k: int) -> float:
        """Log-likelihood ratio of the listed terms as independent rare events."""
        weights = self.weights[k]
        found = words.counts(weights.keys(), TERM_SIZES[k])
        return sum(weights[t] * n for t, n in found.items()) - words.n * self.excess[k]


def votes(text: str, terms: Terms) -> tuple[list[int], Words]:
    """1 for a defect, 0 against it, -1 for no opinion, per labeller; and the words."""
    b = text.encode("utf-8", "surrogatepass")
    tokens = b.split()
    n = len(tokens)
    spoken_words, echoes = spoken(text)
    words = Words(spoken_words)
    letters, upper = count_of(b, _LETTERS), count_of(b, _UPPER)
    visible, symbols = len(b) - count_of(b, _SPACES), count_of(b, _SYMBOLS)
    bars = b.count(b"|")
    out = {}

    def say(name: str, able: bool, yes: bool) -> None:
        out[name] = int(yes) if able else -1

    say("upper_letters", letters >= 20, upper >= 0.4 * letters)
    say("upper_words", n >= 4, upper > n and len(_UPPER_WORD.findall(b)) >= 0.3 * n)
    say("bangs", n >= 4, b.count(b"!!") >= 0.2 * n)
    say("symbol_share", visible >= 20, symbols >= 0.08 * visible)
    say("symbol_words", n >= 4, symbols >= 0.2 * n and len(_MARKED.findall(b)) >= 0.2 * n)
    say("symbol_runs", n >= 4, symbols >= 0.6 * n and len(_RUN.findall(b)) >= 0.2 * n)
    say("bars", n >= 4, bars >= 0.08 * n)
    lines = b.split(b"\n") if bars else []
    say("barred_lines", n >= 4, bars > 0 and sum(b"|" in x for x in lines) >= 0.3 * len(lines))
    say("bar_pairs", n >= 4, b.count(b" | ") >= 0.08 * n)
    say("few_words", n >= 40, len(set(tokens)) <= 0.4 * n)
    say("echoes", n >= 10, echoes >= 0.3 * n)
    say("compressible", len(b) >= 300, len(zlib.compress(b, 1)) <= 0.3 * len(b))
    sentences = [s for x in _SENTENCE.split(b) if (s := x.strip())]
    say("same_sentences", len(sentences) >= 4, len(set(sentences)) <= 0.5 * len(sentences))
    for k, name in enumerate(FAMILIES["toxic"]):
        able = bool(words.n and terms.weights[k])
        say(name, able, able and terms.evidence(words, k) >= TOXIC_EVIDENCE)
    return [out[name] for name in LABELLERS], words


def _share(column, rows: int, total: int):
    """A share of the rows by hash, `rows` of them in expectation."""
    return F.pmod(column, F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, total)))


def learn_terms(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", rows: int = LABELLED_ROWS) -> Terms:
    """Terms that mark toxic documents, from about `rows` labelled rows.

    Equal texts count once, so that a copied document does not make its own words suspicious; one of them that
    is labelled toxic makes the text toxic. Terms are
    counted per task and summed by Spark; at most TERMS of a reading reach the driver.
    """
    need(labels, id, "toxic")
    known = labels.where(F.col(id).isNotNull() & F.col("toxic").isNotNull()).groupBy(id).agg(F.max("toxic").alias("_toxic"))
    chosen = stored(known.where(_share(F.xxhash64(id), rows, labels.count())).select(F.col(id).alias("_id"), "_toxic"), "labelled")
    chosen = F.broadcast(chosen) if small(chosen) else chosen
    picked = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL").join(chosen, "_id")
    texts = picked.groupBy("_text").agg(F.max("_toxic").cast("int").alias("_toxic"))

    def rows_of(found, totals):
        rows = [(k, t, *x) for (k, t), x in found.items()]
        rows.append((-1, "", totals[0], totals[1], totals["docs", 1]))
        found.clear()
        totals.clear()
        for at in range(0, len(rows), 10_000):
            k, t, a, b, c = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(t), *(pa.array(x, pa.int64()) for x in (a, b, c))],
                names=["k", "term", "other", "toxic", "docs"],
            )

    def count(batches):
        totals, found = Counter(), {}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words, _ = spoken(text.as_py())
                totals[toxic] += len(words)
                totals["docs", toxic] += 1
                for k, size in enumerate(TERM_SIZES):
                    for term, n in Counter(starts(words, size)).items():
                        entry = found.setdefault((k, term), [0, 0, 0])
                        entry[toxic] += n
                        entry[2] += toxic
                if len(found) > 50_000:  # Spark adds up what a task returns in parts
                    yield from rows_of(found, totals)
        yield from rows_of(found, totals)

    counted = texts.mapInArrow(count, "k int, term string, other long, toxic long, docs long").groupBy("k", "term").agg(
        *(F.sum(c).alias(c) for c in ("other", "toxic", "docs"))
    )
    summed = stored(counted.where(f"k < 0 OR docs >= {TERM_DOCS}"), "terms")
    total = summed.where("k = -1").first()
    terms = Terms()
    if total is None or not total["toxic"] or not total["other"]:
        return terms
    ratio = (F.col("toxic") / total["toxic"]) / ((F.col("other") + 1) / total["other"])
    both = F.col("toxic") + F.col("other")
    share = total["toxic"] / (total["toxic"] + total["other"])
    gain = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (both * share))
        + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (both * (1 - share)))).otherwise(0.0)
    )
    able = summed.where(
        (F.col("k") >= 0) & (F.length("term") > 2) & (F.col("docs") >= TERM_DOCS) & (ratio >= TERM_RATIO) & (gain >= TERM_GAIN)
    )
    for k in range(len(TERM_SIZES)):
        for r in able.where(F.col("k") == k).orderBy(F.desc("toxic"), "term").limit(TERMS).collect():
            high, low = r["toxic"] / total["toxic"], (r["other"] + 1) / total["other"]
            terms.weights[k][r["term"]] = math.log(high / low)
            terms.excess[k] += high - low
    return terms


@dataclass
class LabelModel:
    """Per family its prior, and per labeller how often it votes 1 with and without the defect."""

    prior: dict[str, float]
    hit: list[float]
    alarm: list[float]

    def posterior(self, vote: list[int]) -> float:
        """Probability that any defect is there; families are independent of each other."""
        clean = 1.0
        for family, names in FAMILIES.items():
            at = LABELLERS.index(names[0])
            with_, without = math.log(self.prior[family]), math.log(1 - self.prior[family])
            for j in range(at, at + len(names)):
                if vote[j] >= 0:
                    with_ += math.log(self.hit[j] if vote[j] else 1 - self.hit[j])
                    without += math.log(self.alarm[j] if vote[j] else 1 - self.alarm[j])
            clean *= 1 / (1 + math.exp(min(500, with_ - without)))
        return 1 - clean


def fit_labels(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, family by family.

    Pseudo-counts keep every rate inside (0, 1) and say beforehand that labellers are
    better than chance, which tells the two sides apart.
    """
    prior, hit, alarm = {}, [0.0] * len(LABELLERS), [0.0] * len(LABELLERS)
    for family, names in FAMILIES.items():
        at, size = LABELLERS.index(names[0]), len(names)
        seen: Counter = Counter()
        for pattern, n in patterns.items():
            seen[pattern[at : at + size]] += n
        votes_ = np.array(list(seen), float).reshape(len(seen), size)
        n = np.array(list(seen.values()), float)
        said = votes_ >= 0
        yes = votes_ == 1
        p, h, a = 0.05, np.full(size, 0.9), np.full(size, 0.01)
        for _ in range(rounds):
            logs = [
                math.log(w) + (np.where(yes, np.log(r), np.log1p(-r)) * said).sum(1) for w, r in ((p, h), (1 - p, a))
            ]
            z = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
            bad, good = (n * z)[:, None], (n * (1 - z))[:, None]
            h = ((bad * yes).sum(0) + 9) / ((bad * said).sum(0) + 10)
            a = ((good * yes).sum(0) + 0.1) / ((good * said).sum(0) + 10)
            p = ((n * z).sum() + 0.5) / (n.sum() + 10)
        prior[family] = p
        hit[at : at + size], alarm[at : at + size] = h.tolist(), a.tolist()
    return LabelModel(prior, hit, alarm)


class Hashed(dict):
    """Feature number of each text asked for; emptied when it has grown large."""

    def __missing__(self, key: str) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[key] = zlib.crc32(key.encode("utf-8", "surrogatepass")) % FEATURES
        return at


def features(vote: list[int], words: Words, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: each vote, and the share of each word beginning."""
    said = [hashed[f"vote {name} {v}"] for name, v in zip(LABELLERS, vote) if v >= 0]
    at = np.array([*said, *map(hashed.__getitem__, words.starts)], np.int64)
    shares = np.fromiter(words.starts.values(), float, len(words.starts)) / max(1, words.n)
    return at, np.concatenate([np.ones(len(said)), shares])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model (the last is the constant) by gradient descent with per-weight steps."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    at = np.concatenate([a for a, _ in rows])
    values = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    used, at = np.unique(at, return_inverse=True)
    w, constant, squares = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8)
    square = 1e-8
    for _ in range(rounds):
        z = np.bincount(row, values * w[at], len(rows)) + constant
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        slope = np.bincount(at, values * error[row], len(used)) / len(rows) + ridge * w
        squares += slope**2
        w -= rate * slope / np.sqrt(squares)
        square += error.mean() ** 2
        constant -= rate * error.mean() / math.sqrt(square)
    weights[used] = w
    weights[-1] = constant
    return weights


@dataclass
class Classifier:
    terms: Terms
    labels: LabelModel
    weights: np.ndarray
    hashed: Hashed = field(default_factory=Hashed)

    def score(self, text: str) -> float:
        vote, words = votes(text, self.terms)
        at, values = features(vote, words, self.hashed)
        z = float(self.weights[at] @ values) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Votes of all documents -> label model -> scorer trained on about `train_rows` of them.

    Vote patterns are counted over the whole table; the driver gets one row per pattern, and
    the hashed features of the training rows.
    """
    need(docs, id, text)
    terms = learn_terms(docs, labels, id, text)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def vote(batches):
        for batch in batches:
            seen = Counter(bytes(v + 1 for v in votes(t.as_py(), terms)[0]) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["votes", "n"])

    counted = texts.mapInArrow(vote, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = {tuple(b - 1 for b in r["votes"]): r["n"] for r in counted}
    model = fit_labels(patterns)

    kinds = pa.schema([("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.float64())])

    def featured(batches):
        hashed = Hashed()
        for batch in batches:
            rows = []
            for t in batch.column(0):
                v, words = votes(t.as_py(), terms)
                at, values = features(v, words, hashed)
                rows.append({"at": at, "x": values, "y": model.posterior(v)})
                if len(rows) == 200:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    # equal texts fall together, so each is taken once: a copied document cannot swell the sample
    sample = texts.where(_share(F.xxhash64("_text"), train_rows, sum(patterns.values()))).dropDuplicates(["_text"])
    got = sample.mapInArrow(featured, "at array<long>, x array<double>, y double").toArrow()
    y = got.column("y").to_numpy()
    at, x = (got.column(c).combine_chunks() for c in ("at", "x"))
    ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())]) if len(y) else np.zeros(1, int)
    at, x = at.flatten().to_numpy(), x.flatten().to_numpy()
    rows = [(at[a:b], x[a:b]) for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(y)), key=lambda i: (y[i], rows[i][0].tobytes(), rows[i][1].tobytes()))  # no matter which task came first
    return Classifier(terms, model, fit_scorer([rows[i] for i in order], y[order]))


def score(docs: DataFrame, model: Classifier, text: str = "text", name: str = "reject_score") -> DataFrame:
    """The rows with the probability that they should be rejected; nothing is shuffled.

    The model (word lists of bounded length, rates, FEATURES weights) is broadcast.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        return texts.map(shared.value.score)

    return docs.withColumn(name, scored(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", reject: float = REJECT) -> DataFrame:
    """id, reject_score and kept for every row.

    Null, empty and very short texts give labellers no opinion and are kept unless the
    scorer learned otherwise. Equal texts get equal scores. Without labels the toxic labellers abstain. An
    empty table gives no rows; columns other than id and text are not read.
    """
    model = fit(docs, labels, id, text)
    return score(docs.select(id, text), model, text).select(
        id, "reject_score", (F.col("reject_score") < reject).alias("kept")
    )
