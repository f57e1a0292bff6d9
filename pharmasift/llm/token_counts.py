"""Token counts of whole texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pharmasift.llm.common import need
from pharmasift.llm.encode import Words, grouped, spaced_pieces

LIMIT = 512


def count_tokens(docs: DataFrame, tokenizer: str, keep=("doc_id",), text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`keep` columns, n_bytes, n_tokens and over_limit for every row.

    Only lengths leave the Python workers. Inside a task texts are encoded in batches of
    equal bytes, and a long text is split where its tokens cannot join, so memory does
    not grow with its length. Null text counts as empty: 0 tokens. Empty and repeated rows give
    one row each; other columns of the input are not read. No shuffle.
    """
    need(docs, text, *keep)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def count(batches):
        words = Words(tokenizer, spaced_pieces, len, sum)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            n = [0] * len(texts)
            for group in grouped((i, t.as_py()) for i, t in enumerate(texts)):
                for (i, _), more in zip(group, words.encode([part for _, part in group])):
                    n[i] += more
            size = pa.array([t.as_buffer().size for t in texts], pa.int64())
            arrays = [*batch.columns[:-1], pa.array(n, pa.int64()), size]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return rows.mapInArrow(count, schema).select(
        *keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
