"""Registered queries of this subpackage and, where SQL can say them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pharmasift.llm import (
    alignment,
    chat,
    collocations,
    contamination,
    exact_dedup,
    langid,
    near_dedup,
    packing,
    quality,
    secrets,
    sharding,
    token_counts,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: A conversation whose texts hold the template's own control strings.
HARD_TEXT = r"\### Assistant: </turn> ok"


@query(
    "op2_chat",
    r"""
    WITH c AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), f AS (
        SELECT *, '### ' || upper(role[1]) || role[2:] || ': ' ||
            replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') || '</turn>' || chr(10) AS formatted
        FROM c
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id
    """,
)
def op2(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], turns.schema)
    return chat.read_back(chat.format_log(chat.log_of(turns.union(hard))))


@query(
    "op3_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
               strlen(coalesce(html, '')) AS n
        FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op3(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_quality")
def op4(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_language_id")
def op5(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query(
    "op6_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
        FROM documents
    ), g AS (
        SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size
        FROM n
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM g
    """,
)
def op6(spark, sf_dir):
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


@query(
    "op7_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN [w]
            ELSE list_transform(range(1, len(w)), lambda i: w[i:i + 1]) END) AS s
        FROM w WHERE len(w) > 0
    ), n AS (SELECT doc_id, len(s) AS n, s FROM s),
    c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, any_value(n) AS n FROM n GROUP BY list_sort(s)),
    m AS (SELECT n.doc_id, n.n, c.rep FROM n JOIN c ON list_sort(n.s) = c.s),
    x AS (SELECT rep, n, unnest(s) AS g FROM c),
    e AS (
        SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep <> b.rep
            AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.rep, b.rep, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), r AS (
        SELECT rep AS a, rep AS root FROM c
        UNION
        SELECT e.b, r.root FROM r JOIN e ON r.a = e.a
    ), o AS (SELECT a AS rep, min(root) AS root FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(o.root, d.doc_id) AS component_id,
           d.doc_id = coalesce(o.root, d.doc_id) AS kept
    FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN o ON o.rep = m.rep
    """,
)
def op7(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op9_decontamination",
    r"""
    WITH w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
        FROM documents
    ), b AS (
        SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
        FROM benchmark
    ), z AS (SELECT DISTINCT least(len(w), 5) AS m FROM b WHERE len(w) > 0),
    g AS (
        SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS s
        FROM w CROSS JOIN z WHERE len(w) >= m
    ), i AS (
        SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
            lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
        FROM b WHERE len(w) > 0
    ), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, i.item_id, n_item, count(*) AS n_shared
    FROM g JOIN i USING (s) JOIN n ON n.item_id = i.item_id
    GROUP BY doc_id, i.item_id, n_item
    HAVING 100 * count(*) >= 80 * n_item
    """,
)
def op9(spark, sf_dir):
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secrets")
def op10(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query(
    "op11_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM p
    ), g AS (
        SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda m:
            list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
        FROM w
    ), f AS (
        SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, phrase
    ), n AS (
        SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(w) = 1 GROUP BY lang
    ), c AS (SELECT * FROM f WHERE len(w) > 1 AND a >= 30),
    k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(2000000 * k.a::HUGEINT // (x.a + y.a) AS BIGINT) AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
        JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (
        SELECT lang, a, unnest(flatten(list_transform(range(2, len(w)), lambda m:
            list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase
        FROM c
    ), o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY lang, phrase),
    t AS (
        SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
               row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
        FROM b LEFT JOIN o USING (lang, phrase)
        WHERE around IS NULL OR 100 * around < 80 * b.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_sharding")
def op13(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))
