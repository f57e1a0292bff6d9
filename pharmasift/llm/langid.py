"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pharmasift.llm.common import need

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
ALPHA = 0.1
#: Documents a language is learned from, in expectation: a fixed share by hash of the id.
TRAIN_DOCS = 5000
#: More languages than this (a parameter) are an error: the broadcast matrix has 65,537 numbers for each.
LANGUAGES = 256
#: Characters scored together.
GROUP_CHARS = 256 * 1024
UNKNOWN = "und"


class Grams:
    """Bucket numbers of the n-grams of texts, as one flat array with a start per text."""

    def __init__(self, orders=ORDERS, buckets: int = BUCKETS):
        self.orders, self.buckets = orders, buckets
        self.letter = np.array([chr(c).isalpha() for c in range(0x10000)])
        draw = np.random.RandomState(7)
        self.factors = {n: draw.randint(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1) for n in orders}

    def letters(self, codes: np.ndarray) -> np.ndarray:
        known = self.letter[np.minimum(codes, 0xFFFF)]
        high = codes > 0xFFFF
        if high.any():
            for c in np.unique(codes[high]):
                known[codes == c] = chr(c).isalpha()
        return known

    def of(self, texts: list[str], context: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets (n-gram orders side by side), start of each text, letters of each text.

        Texts are in lower case; every other character than a letter becomes a blank; n-grams of
        blanks only go to the spare bucket. Texts are parted by blanks, so none sees another. The last
        `context` characters of a text end n-grams but begin none.
        """
        wide = max(self.orders)
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        pad = np.zeros(wide, np.uint32)
        codes = np.concatenate([x for part in parts for x in (part, pad)])
        starts = np.cumsum([0, *(len(p) + wide for p in parts)])[:-1]
        letter = self.letters(codes)
        codes = np.where(letter, codes, np.uint32(0))
        begins = np.ones(len(codes), bool)
        for start, part, more in zip(starts, parts, context):
            begins[start + len(part) - more : start + len(part)] = False
        counts = np.add.reduceat(letter & begins, starts, dtype=np.int64)
        n = len(codes) - wide + 1
        out = np.empty((n + wide - 1, len(self.orders)), np.int64)
        for k, order in enumerate(self.orders):
            h, some = np.full(n, order, np.uint32), np.zeros(n, bool)
            for j in range(order):
                h += codes[j : n + j] * self.factors[order][j]
                some |= letter[j : n + j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            out[:n, k] = np.where(some & begins[:n], h % np.uint32(self.buckets), self.buckets)
            out[n:, k] = self.buckets
        return out, starts, counts


def grouped(texts, wide: int, limit: int = GROUP_CHARS):
    """[(row, text in lower case, context)] lists of about `limit` characters.

    A long text is cut into several entries; each but the last also has the next `wide` - 1 characters, so
    that the n-grams of the entries are those of the whole text.
    """
    group, size = [], 0
    for row, text in texts:
        text = text.lower()
        for at in range(0, max(1, len(text)), limit):
            some = text[at : at + limit + wide - 1]
            group.append((row, some, max(0, len(some) - limit)))
            size += len(some)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    train_docs: int = TRAIN_DOCS, orders=ORDERS, buckets: int = BUCKETS, alpha: float = ALPHA,
    most_languages: int = LANGUAGES,
) -> Model:
    """Log-probabilities per bucket and language.

    Rows without text or language are left out. Of each language about `train_docs` documents, chosen by
    a hash of id and text, are read; n-gram counts are summed per task, then over tasks by Spark. The driver
    gets languages x buckets numbers.
    """
    need(docs, id, text, lang)
    labelled = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL"
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets + 1, 0)), np.zeros(0))
    share = F.create_map(*(x for l in languages for x in (F.lit(l), F.lit(min(1.0, train_docs / sizes[l])))))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < share[F.col("lang")]).select("text", "lang")
    number = {l: i for i, l in enumerate(languages)}

    def count(batches):
        grams = Grams(orders, buckets)
        counts: dict[int, np.ndarray] = {}  # of the languages that this task meets
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for group in grouped(((i, t.as_py()) for i, t in enumerate(batch.column(0))), max(orders)):
                found, starts, _ = grams.of([t for _, t, _ in group], [more for *_, more in group])
                ends = [*starts[1:], len(found)]
                for (i, *_), a, b in zip(group, starts, ends):
                    own = counts.setdefault(number[langs[i]], np.zeros(buckets + 1, np.int64))
                    own += np.bincount(found[a:b].ravel(), minlength=buckets + 1)
        for language, own in counts.items():
            b = np.flatnonzero(own[:buckets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (np.full(len(b), language), b, own[b])], names=["language", "bucket", "n"]
            )

    summed = sample.mapInArrow(count, "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts = np.zeros((buckets, len(languages)))
    counts[got.column("bucket").to_numpy(), got.column("language").to_numpy()] = got.column("n").to_numpy()
    logs = np.log((counts + alpha) / (counts.sum(0) + alpha * buckets))
    matrix = np.vstack([logs, np.zeros((1, len(languages)))])  # the spare bucket says nothing
    total = np.array([sizes[l] for l in languages], float)
    return Model(languages, matrix, np.log(total / total.sum()))


def predict(docs: DataFrame, model: Model, keep=("doc_id",), text: str = "text", orders=ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """`keep` columns, lang_pred and score (posterior probability) for every row.

    Reads the whole text and nothing else. Null texts, texts without a letter, and all texts if
    nothing was learned get `und` and 0. Empty and repeated rows give one row each; other columns of the input
    are not read. The matrix is broadcast: languages (checked when learned) x buckets.
    """
    need(docs, text, *keep)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.matrix, model.prior))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def score(batches):
        grams = Grams(orders, buckets)
        languages, matrix, prior = shared.value
        for batch in batches:
            n = batch.num_rows
            total, letters = np.zeros((n, len(languages))), np.zeros(n, np.int64)
            for group in grouped(((i, t.as_py()) for i, t in enumerate(batch.column(batch.num_columns - 1))), max(orders)):
                found, starts, some = grams.of([t for _, t, _ in group], [more for *_, more in group])
                at = [i for i, *_ in group]
                if languages:
                    each = sum(matrix[found[:, k]] for k in range(found.shape[1]))
                    np.add.at(total, at, np.add.reduceat(each, starts, axis=0))
                np.add.at(letters, at, some)
            known = (letters > 0) & bool(languages)
            names, best = [UNKNOWN] * n, np.zeros(n)
            if languages:
                total += prior
                total -= total.max(1, keepdims=True)
                chance = np.exp(total)
                chance /= chance.sum(1, keepdims=True)
                top = chance.argmax(1)
                names = [languages[t] if k else UNKNOWN for t, k in zip(top, known)]
                best = np.where(known, chance.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(best, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score: learned from the rows not held out, predicted for all."""
    learned = train(docs.where(~held_out(F.col(id))), id, text, lang)
    return predict(docs, learned, (id,), text).select(F.col(id), held_out(F.col(id)).alias("held_out"), "lang_pred", "score")
