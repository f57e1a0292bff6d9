"""The pipeline's stages against brute force, each on its own input."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pharmasift.llm import common, quality
from tests.llm.test_contamination import brute
from tests.llm.test_duplicates import exact, near
from tests.llm.test_tokens import check_packing

DIR = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(common.stored(stage(spark, steps[-1], DIR), name))
    return steps


def test_columns_and_rows_stay_as_they_are(stages):
    first = {tuple(r) for r in stages[0].collect()}
    for step in stages[1:-1]:
        rows = step.select(*stages[0].columns).collect()
        assert step.columns == stages[0].columns and len(rows) == len(set(rows)) and set(rows) <= first


def test_quality_stage_follows_the_classifier(spark, stages):
    marks = quality.classify(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in marks.where("kept").collect())


def test_duplicate_stages(stages):
    one, two, three = (pairs(s) for s in stages[1:4])
    assert sorted(i for i, _ in two) == sorted(r[0] for r in exact(one) if r[3])
    assert sorted(i for i, _ in three) == sorted(r[0] for r in near(two, 5) if r[3])
    assert len(three) < len(two) < len(one)


def test_benchmark_stage(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    three, four = pairs(stages[3]), pairs(stages[4])
    found = {d for d, *_ in brute(three, items)}
    assert found and sorted(i for i, _ in four) == sorted(i for i, _ in three if i not in found)


def test_packing_stage_and_run(spark, stages):
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stages[5].collect()
    n = check_packing(rows, dict(pairs(stages[4])), word, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    ran = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, ran.drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


def test_odd_documents_go_through(spark):
    rows = [
        (1, None, "en", None, 0), (2, "", None, "s", 0), (3, " ", "x", "s", 1), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (None, "two words", "en", "s", 9),
        (6, "a long text with many words " * 5000, "en", "s", 1), (7, "a long text with many words", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{DIR}/documents.parquet").schema)
    for table in (docs, docs.limit(0)):
        step = table
        for name, stage in corpus_pipeline.STAGES:
            step = common.stored(stage(spark, step, DIR), name)
        assert step.columns[:2] == ["doc_id", "piece"]
        assert step.isEmpty() == table.isEmpty()


def test_rows_are_decided_one_by_one(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text

    def text(n, *last):
        return " ".join([*(f"w{n}x{i}" for i in range(60)), *last])

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
        return sorted(pairs(stage(spark, docs, DIR)), key=str)

    clean = [(None, text(1)), (7, text(2))]
    # near copies of a document with an id, of each other under one id, and of each other without ids
    kept = [(3, text(3)), (4, text(4, "a")), (5, text(6)), (5, text(7))]
    gone = [(None, text(3, "a")), (7, text(3, "b")), (5, text(6, "a"))]
    got = left(corpus_pipeline.near_copies, [*clean, *kept, *gone, (4, text(4, "b")), (None, text(8, "a")), (None, text(8, "b"))])
    one_of = [{(5, text(6)), (5, text(6, "a"))}, {(4, text(4, "a")), (4, text(4, "b"))}, {(None, text(8, "a")), (None, text(8, "b"))}]
    assert all(len(group & set(got)) == 1 for group in one_of)
    sure = {*clean, (3, text(3)), (5, text(7))}
    assert len(got) == len(sure) + len(one_of) and sure <= set(got)
    dirty = [(None, f"{text(1)} {item}"), (7, f"{item} {text(2)}")]
    assert left(corpus_pipeline.clean_of_benchmark, [*clean, *dirty]) == sorted(clean, key=str)
