import glob
import json
import os

import pytest

from pyspark.sql import functions as F

from pharmasift.operators.quality import split_valid, stored_brief_rules
from pharmasift.sources import messages, tables
from pharmasift.streaming import ingest
from tests.conftest import rows


def test_append_is_idempotent(spark, frame, tmp_path):
    path = str(tmp_path / "pairs")
    first = frame([(1, "a", "x", "2023Q1"), (1, "a", "x", "2023Q1"), (2, "a", "x", "2023Q1")], "primaryid long, drug_key string, pt string, source_quarter string")
    tables.append_new(first, path, partition="source_quarter")
    tables.append_new(first, path, partition="source_quarter")
    more = frame([(2, "a", "x", "2023Q2"), (3, "b", "x", "2023Q2")], first.schema)
    tables.append_new(more, path, partition="source_quarter")
    assert rows(spark.read.parquet(path), "primaryid", "source_quarter") == [(1, "2023Q1"), (2, "2023Q1"), (3, "2023Q2")]
    pruned = spark.read.parquet(path).filter("source_quarter = '2023Q2'")
    assert "PartitionFilters: [isnotnull(source_quarter" in pruned._jdf.queryExecution().executedPlan().toString()


def test_upsert(frame):
    target = frame([("a", 1, "keep"), ("b", 1, "old")], "k string, v int, note string")
    source = frame([("b", 2, "new"), ("c", 1, "first"), ("c", 3, "later")], "k string, v int, note string")
    assert rows(tables.upsert(target, source, ["k"], ["v"])) == [("a", 1, "keep"), ("b", 2, "new"), ("c", 3, "later")]
    assert rows(tables.upsert(target.limit(0), source, ["k"], ["v"])) == [("b", 2, "new"), ("c", 3, "later")]


def test_table_can_be_replaced_by_what_was_computed_from_it(frame, tmp_path):
    root = str(tmp_path / "briefs")
    old = tables.replace(frame([("a", 1), ("b", 1)], "k string, v int"), root)
    new = tables.replace(old.where("k = 'b'").withColumn("v", F.col("v") + 4), root)
    assert rows(new) == [("b", 5)] and rows(old) == [("a", 1), ("b", 1)]


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, frame, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int, note string"
    first = [(f"k{i}", 1, None) for i in range(60)] + [(None, 1, "null key")]
    tables.upsert_into(frame(first, schema), path, ["k"], ["v"], buckets=8)
    before = files(path)
    change = frame([("k3", 5, "new"), ("k3", 4, "older"), ("k3", 5, "new")], schema)
    for _ in range(2):  # once more after a failure gives the same
        numbers = tables.upsert_into(change, path, ["k"], ["v"], buckets=8)
        assert len(numbers) == 1
    after = files(path)
    kept = {f: t for f, t in before.items() if f"_bucket={numbers[0]}/" not in f}
    assert kept.items() <= after.items() and len(kept) >= 5
    assert not {f for f in before if f"_bucket={numbers[0]}/" in f} & set(after)
    expected = sorted([r for r in first if r[0] != "k3"] + [("k3", 5, "new")], key=str)
    assert rows(spark.read.parquet(path), "k", "v", "note") == expected
    assert tables.upsert_into(change.limit(0), path, ["k"], buckets=8) == [] and files(path) == after
    tables.upsert_into(frame([("n", 1, None)], schema), path, ["k"], buckets=8)
    assert spark.read.parquet(path).count() == len(first) + 1


def test_append_reads_touched_buckets_only(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    pairs_ = frame([(i, "d", "r", "q") for i in range(50)] + [(1, "d", "r", "q")], "primaryid long, drug_key string, pt string, source_quarter string")
    for _ in range(2):
        tables.append_new(pairs_, path, partition="source_quarter", buckets=8)
    seen = []
    keys = tables.distinct_keys
    monkeypatch.setattr(tables, "distinct_keys", lambda df, k: seen.append(df) or keys(df, k))
    tables.append_new(frame([(7, "d", "r", "q"), (7, "d", "x", "q")], pairs_.schema).where("pt = 'r'"), path, partition="source_quarter", buckets=8)
    assert spark.read.parquet(path).count() == 50
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_decisions_are_checked_and_upper_cased(frame):
    df = frame([("a", "x", "approve"), ("a", "x", "escalate"), (None, "x", "REJECT"), ("a", "x", None)], "drug_key string, pt string, decision string")
    good, bad = tables.split_decisions(df)
    assert rows(good) == [("a", "x", "APPROVE")]
    assert sorted(len(r.violations) for r in bad.collect()) == [1, 1, 1]
    assert tables.split_decisions(df, ("approve", "reject", "escalate"))[0].count() == 2


def test_name_clip_and_nan(frame):
    names = frame([("x" * 1200, "y" * 1200, "1")], "prod_ai string, canonical_name string, rxcui string")
    assert len(tables.clip_names(names).first().prod_ai) == 1200
    clipped = tables.clip_names(names, tables.PUBLISHED_NAME_CHARS).first()
    assert len(clipped.prod_ai) == len(clipped.canonical_name) == 1000
    cleaned = tables.null_nan(frame([(float("nan"), " ", 1), (1.5, "z", 2)], "d double, s string, n int"))
    assert rows(cleaned) == [(1.5, "z", 2), (None, None, 1)]


def test_corpus_export_is_sorted(spark, frame, tmp_path):
    docs = frame([("b", "2", "t"), ("a", "9", "t"), ("a", "1", "t")], "group_key string, pmid string, text string")
    tables.export_corpus(docs, str(tmp_path / "out"))
    lines = []
    for name in sorted(os.listdir(tmp_path / "out")):
        if name.startswith("part"):
            lines += [json.loads(line) for line in open(tmp_path / "out" / name)]
    assert [(x["group_key"], x["pmid"]) for x in lines] == [("a", "1"), ("a", "9"), ("b", "2")]
    assert rows(tables.corpus_counts(docs)) == [("a", 2), ("b", 1)]


def test_jdbc_round_trip(spark, frame, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = frame([(1, 0.5, "a"), (2, 1.5, "b"), (3, 2.5, None)], "id int, v double, s string")
    try:
        tables.write_jdbc(df, url, "T1", "append", **options)
    except Exception as error:
        pytest.skip(f"no embedded JDBC driver: {str(error)[:80]}")
    tables.write_jdbc(df.filter("id = 1"), url, "T1", "append", **options)
    assert tables.read_jdbc(spark, url, "T1", **options).count() == 4
    parallel = tables.read_jdbc(spark, url, "T1", ("ID", 1, 4, 3), **options)
    assert parallel.count() == 4 and parallel.rdd.getNumPartitions() == 3
    tables.copy_table(spark, url, "T1", "T2", **options)
    assert tables.read_jdbc(spark, url, "T2", **options).count() == 4


def test_stored_brief_rules(frame):
    schema = "drug_key string, pt string, priority string, stat_score double, lit_score double, input_tokens long, output_tokens long, generation_error boolean"
    df = frame([("d", "ok", "P1", 0.5, None, 1, None, False), ("d", "err", None, None, None, None, None, True),
                ("d", "tier", "P7", 0.5, 0.5, 1, 1, False), ("d", "range", "P1", 1.5, 0.5, -1, 1, False)], schema)
    good, bad = split_valid(df, stored_brief_rules())
    assert rows(good, "pt") == [("err",), ("ok",)]
    assert rows(bad, "pt", "violations") == [("range", ["stat_score in [0, 1]", "input_tokens >= 0"]), ("tier", ["priority is P1-P4"])]


def put(folder, name, *records):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def demo(p, case, version, quarter):
    return {"primaryid": str(p), "caseid": str(case), "caseversion": str(version), "fda_dt": "20230101", "source_quarter": quarter}


def test_second_run_reads_only_new_files(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(src, "q1.json", demo(1, 1, 1, "2023Q1"), demo(2, 2, 1, "2023Q1"), {"primaryid": None})

    def run():
        q = ingest.ingest_available(ingest.message_stream(spark, src), messages.SPECS["DEMO"], dst, state)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    assert run() == 3
    put(src, "q2.json", demo(3, 1, 2, "2023Q2"))
    assert run() == 1 and run() == 0
    assert rows(spark.read.parquet(dst), "primaryid", "source_quarter") == [(1, "2023Q1"), (2, "2023Q1"), (3, "2023Q2")]


def test_late_lower_versions_lose(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(src, "a.json", demo(1, 1, 1, "2023Q1"), demo(3, 1, 3, "2023Q1"), demo(5, 2, 1, "2023Q1"))

    def run():
        stream = messages.parse_entity(ingest.message_stream(spark, src), messages.SPECS["DEMO"])
        ingest.track_versions(stream, dst, state).awaitTermination()
        return rows(ingest.current_versions(spark, dst), "caseid", "primaryid")

    assert run() == [(1, 3), (2, 5)]
    put(src, "b.json", demo(2, 1, 2, "2023Q2"), demo(6, 2, 2, "2023Q2"))
    assert run() == [(1, 3), (2, 6)]


DEMO = "primaryid long, caseid long, caseversion int, fda_dt string, source_quarter string"


def test_kept_versions_survive_a_restart_and_stay_one_row_per_case(spark, frame, tmp_path):
    """Batches, a late lower version, an equal version with a higher id, and a stop between them."""
    batches = [
        [(1, 10, 1, "a", "q"), (2, 11, 1, "a", "q"), (3, 12, 5, "a", "q")],
        [(4, 10, 3, "b", "q"), (5, 12, 4, "b", "q")],
        [(6, 10, 2, "c", "q"), (7, 11, 1, "c", "q"), (8, 13, 1, "c", "q")],
    ]
    source, target, state = str(tmp_path / "in"), str(tmp_path / "cases"), str(tmp_path / "state")
    everything = []
    for batch in batches:
        frame(batch, DEMO).coalesce(1).write.mode("append").parquet(source)
        everything += batch
        stream = spark.readStream.schema(DEMO).parquet(source)
        for _ in range(2):  # the second start finds nothing new
            ingest.keep_versions(stream, target, state, buckets=4).awaitTermination()
        expected = rows(ingest.latest_version(frame(everything, DEMO)), "caseid", "caseversion", "primaryid")
        assert rows(ingest.kept_versions(spark, target), "caseid", "caseversion", "primaryid") == expected
    assert len(files(target)) <= 4
