from pyspark.sql import functions as F

from pharmasift.operators import disproportionality as dp
from pharmasift.operators import temporal
from pharmasift.plans import flagging
from tests.conftest import rows

PAIR = "primaryid long, drug_key string, pt string, death_flag int, hosp_flag int, lt_flag int, source_quarter string"


def pair(n, drug, pt, quarter="2023Q1", flags=(0, 0, 0)):
    return (n, drug, pt, *flags, quarter)


def sample_pairs(spark, seed):
    df = spark.range(8000).select(
        (F.xxhash64("id", F.lit(seed)) % 1500).alias("primaryid"),
        F.concat(F.lit("d"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(20)).cast("string")).alias("drug_key"),
        F.concat(F.lit("r"), F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(12)).cast("string")).alias("pt"),
        F.pmod(F.xxhash64("id", F.lit(seed + 3)), F.lit(2)).cast("int").alias("death_flag"),
        F.lit(0).alias("hosp_flag"), F.lit(1).alias("lt_flag"), F.lit("2023Q1").alias("source_quarter"),
    )
    return df.dropDuplicates(["primaryid", "drug_key", "pt"])


def test_ratio_arithmetic(frame):
    cells = frame([("d", "r", 67, 0, 0, 0)], "drug_key string, pt string, a long, death_count long, hosp_count long, lt_count long")
    table = dp.ratio_table(
        cells, frame([("d", 1267)], "drug_key string, drug_total long"), frame([("r", 167)], "pt string, reaction_total long"),
        frame([(6367,)], "n_total long"),
    ).first()
    assert (table.a, table.b, table.c, table.d) == (67, 1200, 100, 5000)
    assert abs(table.prr - (67 / 1267) / (100 / 5100)) < 1e-12 and round(table.prr, 2) == 2.70


def test_undefined_ratios_drop(frame):
    only = frame([pair(1, "a", "x"), pair(2, "a", "x")], PAIR)
    assert dp.contingency(only).count() == 0


def test_invariants_of_the_table(spark):
    for seed in (1, 22):
        p = sample_pairs(spark, seed).cache()
        n = p.select("primaryid").distinct().count()
        table = dp.contingency(p)
        bad = table.filter(
            (F.col("a") + F.col("b") + F.col("c") + F.col("d") != n) | (F.col("prr") <= 0)
            | (F.col("a") > F.least("drug_total", "reaction_total")) | (F.col("d") < 0)
        )
        assert table.count() > 100 and bad.count() == 0
        assert rows(table) == rows(dp.contingency(p.drop("source_quarter"), unique=False))


def test_repeated_reports_count_once(frame):
    p = frame([pair(1, "a", "x"), pair(1, "a", "x"), pair(2, "b", "x"), pair(3, "b", "y")], PAIR)
    assert ("a", "x", 1) in rows(dp.cell_counts(p, unique=False), "drug_key", "pt", "a")
    assert rows(dp.drug_totals(p)) == [("a", 1), ("b", 2)] and dp.report_total(p).first()[0] == 3


def test_marked_pairs_need_no_distinct(spark):
    p = sample_pairs(spark, 4)
    limits = dp.Thresholds(prr=0.5, cases=1, other_cases=1, drug_cases=1)
    marked = dp.marked(p).localCheckpoint()
    got = flagging.flag(marked, limits, marked=True)
    assert rows(got) == rows(flagging.flag(p, limits)) and got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("primaryid" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_marks_hold_no_report_in_a_window(frame):
    p = frame([pair(1, "a", "x"), pair(1, "a", "y"), pair(1, "b", "x"), pair(1, "b", "y"), pair(2, "a", "x"), pair(None, "a", "x")], PAIR)
    marked = dp.marked(p)
    assert rows(marked, "primaryid", "drug_key", "pt", "for_drug", "for_reaction", "for_all") == [
        (1, "a", "x", 1, 1, 1), (1, "a", "y", 0, 1, 0), (1, "b", "x", 1, 0, 0), (1, "b", "y", 0, 0, 0), (2, "a", "x", 1, 1, 1),
        (None, "a", "x", 0, 0, 0),
    ]
    assert "unboundedfollowing" not in marked._jdf.queryExecution().executedPlan().toString()


def test_thresholds_are_inclusive_and_junk_goes(spark, frame):
    schema = "drug_key string, pt string, a long, c long, drug_total long, prr double"
    cells = frame(
        [("a", "x", 50, 200, 1000, 2.0), ("b", "x", 50, 200, 1000, 1.99), ("c", "x", 49, 200, 1000, 9.0),
         ("d", "x", 50, 199, 1000, 9.0), ("e", "x", 50, 200, 999, 9.0), ("f", "off label use", 500, 2000, 10000, 9.0)],
        schema,
    )
    table = frame([(t,) for t in dp.JUNK_TERMS], "pt string")
    for junk in (dp.JUNK_TERMS, table):
        assert rows(dp.threshold(cells, dp.Thresholds.production(), junk), "drug_key") == [("a",)]
    assert len(dp.JUNK_TERMS) == 24 and dp.Thresholds.relaxed().cases == 30


def period_case(frame, counts, limit=None):
    p = frame([pair(n, "a", "x", q) for q, k in counts.items() for n in range(k)], PAIR)
    signals = frame([("a", "x")], "drug_key string, pt string")
    return temporal.filter_periods(signals, p).count() == 1


def test_period_rules(frame):
    q = ["2023Q1", "2023Q2", "2023Q3", "2023Q4"]
    assert not period_case(frame, dict(zip(q, (80, 10, 5, 5))))
    assert period_case(frame, dict(zip(q, (25, 25, 25, 25))))
    assert period_case(frame, dict(zip(q, (70, 10, 10, 10))))
    assert not period_case(frame, dict(zip(q, (5, 5, 45, 45))))
    assert period_case(frame, dict(zip(q, (20, 25, 30, 25))))
    assert period_case(frame, {"2023Q1": 9})
    assert not period_case(frame, {"2023Q3": 9})
    assert period_case(frame, {"2023Q1": 5, "2023Q2": 5})


def test_rules_can_be_switched_off(frame):
    p = frame([pair(n, "a", "x", "2023Q3") for n in range(9)] + [pair(99, "b", "x", "2023Q1")], PAIR)
    signals = frame([("a", "x")], "drug_key string, pt string")
    assert temporal.filter_periods(signals, p, None, temporal.LATE_PERIODS, None).count() == 1
    assert temporal.filter_periods(signals, p, None).count() == 0


def test_both_routes_flag_the_same(spark):
    from workload import domain as d

    sf = "/root/testdata/sf0.001"
    direct = flagging.flag_reports(
        d.demo(spark, sf), d.drug(spark, sf), d.reac(spark, sf), d.outc(spark, sf), d.name_map(spark, sf),
        d.SMALL_LIMITS, d.JUNK,
    )
    stored = flagging.flag(d.stored_pairs(spark, sf), d.SMALL_LIMITS, d.JUNK, None, d.LATE, None)
    assert rows(direct) == rows(stored) and direct.count() > 20


def test_signal_plan_has_no_python_and_no_row_product(spark):
    from workload import domain as d

    plan = d.flagged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
