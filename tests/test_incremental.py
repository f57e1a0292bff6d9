"""Signals by differences, and counts of reports without distinct shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from pharmasift.operators import disproportionality as dp
from pharmasift.operators import naming, pairs
from pharmasift.plans import flagging, incremental
from tests.conftest import rows

LIMITS = dp.Thresholds(prr=0.5, cases=1, other_cases=1, drug_cases=1)
DEMO = "primaryid long, caseid long, caseversion int, fda_dt string, source_quarter string"


@pytest.fixture(scope="module")
def reports(frame):
    """Cases with up to three versions over four periods, some reports without drugs, reactions or outcomes."""
    draw = random.Random(7)
    demo, drug, reac, outc = [], [], [], []
    for n in range(160):
        case, q = draw.randrange(70), draw.randrange(4)
        demo.append((n, None if case == 0 else case, draw.randrange(3), "20230101", f"2023Q{q + 1}"))
        for d in draw.sample("abcd", draw.randrange(4)):
            drug.append((n, d, d.upper(), "PS", f"2023Q{q + 1}"))
        for r in draw.sample(["rash", "pain", "fall"], draw.randrange(4)):
            reac.append((n, r, f"2023Q{q + 1}"))
        if n % 3 == 0:
            outc.append((n, draw.choice(["DE", "HO", "LT", "XX"]), f"2023Q{q + 1}"))
    names = naming.load_name_map(frame([], "prod_ai string, rxcui string, canonical_name string"))
    return (
        frame(demo, DEMO), frame(drug, "primaryid long, drugname string, prod_ai string, role_cod string, source_quarter string"),
        frame(reac, "primaryid long, pt string, source_quarter string"), frame(outc, "primaryid long, outc_cod string, source_quarter string"), names,
    )


def added(spark, root, reports, periods):
    state = incremental.SignalState(spark, str(root))
    demo, drug, reac, outc, names = reports
    for name, some in periods:
        own = demo.where(F.col("source_quarter").isin(*some))
        parts = (x.where(F.col("source_quarter").isin(*some)) for x in (drug, reac, outc))
        state.add(name, own, *parts, names)
    return state


def table(df):
    return rows(df.select("drug_key", "pt", "drug_reaction_count", "drug_total", "other_no_reaction_count", "death_count", F.round("prr", 9)))


@pytest.fixture(scope="module")
def at_once(reports):
    built = pairs.build(*reports[:4], reports[4])
    return table(flagging.flag(built, LIMITS, spike_max=0.9, late_periods=("2023Q4",), late_max=0.8))


SPLITS = [
    [("a", ["2023Q1", "2023Q2", "2023Q3", "2023Q4"])],
    [("a", ["2023Q1", "2023Q2"]), ("b", ["2023Q3"]), ("c", ["2023Q4"])],
    [("z", ["2023Q4"]), ("b", ["2023Q1", "2023Q3"]), ("c", []), ("a", ["2023Q2"])],  # older periods later, an empty one
    [("a", ["2023Q1", "2023Q2"]), ("b", ["2023Q3", "2023Q4"]), ("b", ["2023Q3", "2023Q4"])],  # the last one twice
]


@pytest.mark.parametrize("split", range(len(SPLITS)))
def test_batches_equal_all_at_once(spark, reports, at_once, tmp_path, split):
    state = added(spark, tmp_path, reports, SPLITS[split])
    assert table(state.signals(LIMITS, spike_max=0.9, late_periods=("2023Q4",), late_max=0.8)) == at_once and at_once


def test_only_superseded_reports_are_read_again(spark, reports, tmp_path, monkeypatch):
    state = added(spark, tmp_path, reports, [("a", ["2023Q1", "2023Q2", "2023Q3"])])
    read = []
    pairs_of = incremental.SignalState._pairs_of
    monkeypatch.setattr(incremental.SignalState, "_pairs_of", lambda self, r, c: read.append(pairs_of(self, r, c)) or read[-1])
    demo, drug, reac, outc, names = reports
    target = state._read("pairs").select("primaryid", "caseid").where("caseid IS NOT NULL").first()
    one = spark.createDataFrame([(999, target.caseid, 99, "20230101", "2023Q4")], DEMO)
    state.add("b", one, drug.limit(0), reac.limit(0), outc.limit(0), names)
    old = read[0]
    assert {r.primaryid for r in old.select("primaryid").collect()} == {target.primaryid}
    scan = old._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "batch" in filters and "bucket" in filters
    assert state._read("cells").where("batch = 'b' AND a >= 0").count() == 0  # only taken back


def test_flag_reports_applies_the_period_rules(reports, at_once):
    got = flagging.flag_reports(*reports, LIMITS, spike_max=0.9, late_periods=("2023Q4",), late_max=0.8)
    assert table(got) == at_once


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_marginals_need_no_distinct_shuffle(spark, reports, tmp_path):
    """Partial cells of stored pairs take one shuffle if these are bucketed by report, else one more; the rest is small."""
    built = pairs.build(*reports[:4], reports[4])
    built.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    stored.write.option("path", str(tmp_path / "b")).bucketBy(4, "primaryid").sortBy("primaryid").saveAsTable("bucketed_pairs")
    bucketed = spark.table("bucketed_pairs")
    expected = rows(dp.contingency(stored).select("drug_key", "pt", "a", "b", "c", "d", "drug_total", "reaction_total"))
    for df, n in ((stored, 2), (bucketed, 1)):
        partials = dp.partial_cells(dp.marked(df))
        assert shuffles(partials) == n
        got = dp.contingency_of(spark.createDataFrame(partials.collect(), partials.schema))
        assert rows(got.select("drug_key", "pt", "a", "b", "c", "d", "drug_total", "reaction_total")) == expected
    spark.sql("DROP TABLE bucketed_pairs")


def test_batch_is_written_in_bounded_parts_without_windows(spark, reports, tmp_path, monkeypatch):
    """The builder's marks are those of `marked`, and a bucket has as many files as its batch needs."""
    monkeypatch.setattr(dp, "marked", None)
    monkeypatch.setattr(incremental, "task_count", lambda *_: 3 * incremental.BUCKETS)
    added(spark, tmp_path / "s", reports, SPLITS[0])
    monkeypatch.undo()
    got = spark.read.parquet(str(tmp_path / "s" / "pairs"))
    columns = ("primaryid", "drug_key", "pt", *pairs.MARKS)
    assert rows(got, *columns) == rows(dp.marked(pairs.build(*reports[:4], reports[4])), *columns)
    files = got.withColumn("f", F.input_file_name()).groupBy("bucket").agg(F.count_distinct("f").alias("n"), F.count_distinct("primaryid").alias("r"))
    assert files.filter("n > 1").count() > 0 and files.filter("n > least(3, r)").count() == 0
