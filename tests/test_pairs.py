import random
from itertools import product

from pyspark.sql import functions as F

from pharmasift.operators import cases, naming, pairs
from pharmasift.operators import disproportionality as dp
from pharmasift.operators.joins import TASK_BYTES, attach, estimated_bytes, measured_bytes, task_count, trusted_bytes
from tests.conftest import rows

DEMO = "primaryid long, caseid long, caseversion int, fda_dt string, source_quarter string"
DRUG = "primaryid long, role_cod string, prod_ai string, drugname string"
REAC = "primaryid long, pt string"
OUTC = "primaryid long, outc_cod string"
MAP = "prod_ai string, canonical_name string, rxcui string"


def names(frame, rows_=(("X HCL", "x", "9"),)):
    return naming.load_name_map(frame(list(rows_), MAP))


def build(frame, demo, drug, reac, outc=(), **options):
    return pairs.build(
        frame(list(demo), DEMO), frame(list(drug), DRUG), frame(list(reac), REAC), frame(list(outc), OUTC),
        names(frame), **options,
    )


def one_case(n=1, quarter="2023Q1"):
    return [(n, n * 10, 1, "20230105", quarter)]


def test_latest_version_and_ties(frame):
    demo = frame(
        [(1, 5, 1, "a", "q"), (2, 5, 3, "b", "q"), (3, 5, 2, "c", "q"), (7, 6, None, "d", "q"), (8, 6, 1, "e", "q"),
         (10, 9, 2, "f", "q"), (11, 9, 2, "g", "q")],
        DEMO,
    )
    assert rows(cases.latest_version(demo), "primaryid") == [(11,), (2,), (8,)]
    assert cases.latest_version(demo.limit(0)).count() == 0


def test_outcome_flags(frame):
    outc = frame([(1, "de"), (1, "HO"), (2, "LT"), (3, "XX"), (4, None)], OUTC)
    assert rows(cases.outcome_flags(outc)) == [(1, 1, 1, 0), (2, 0, 0, 1), (3, 0, 0, 0), (4, 0, 0, 0)]


def test_name_resolution_order(frame):
    drug = frame(
        [(1, "ps", "x hcl", "brand"), (2, "PS", "Unknown \\ Other", "b"), (3, "PS", None, " Brand\\C "),
         (4, "PS", None, None), (5, "SS", "X HCL", "b"), (6, "PS", "  ", "Shown"), (7, None, "X HCL", "b")],
        DRUG,
    )
    got = naming.normalize(drug, names(frame))
    assert rows(got) == [(1, "x", "9"), (2, "unknown", None), (3, "brand", None), (6, "shown", None)]


def test_name_map_collisions_do_not_multiply(frame):
    mapped = names(frame, [("x hcl", "b", "2"), (" X HCL\\Y", "a", "3"), ("Z", None, "1")])
    assert rows(mapped) == [("X HCL", "a", "3")]
    assert naming.normalize(frame([(1, "PS", "X HCL", "b")], DRUG), mapped).count() == 1


def test_duplicates_collapse_with_smallest_code(frame):
    mapped = names(frame, [("A SALT", "a", "5"), ("A BASE", "a", "3")])
    drug = frame([(1, "PS", "A SALT", "b"), (1, "PS", "A BASE", "b"), (1, "PS", "A SALT", "b")], DRUG)
    assert rows(naming.normalize(drug, mapped)) == [(1, "a", "3")]


def test_two_drugs_two_reactions_make_four_rows(frame):
    got = build(
        frame, one_case(), [(1, "PS", "A", "a"), (1, "PS", "B", "b"), (1, "C", "Z", "z")],
        [(1, "Coma"), (1, " coma "), (1, "Rash")], [(1, "DE")],
    )
    assert rows(got, "drug_key", "pt", "death_flag", "hosp_flag") == [
        ("a", "coma", 1, 0), ("a", "rash", 1, 0), ("b", "coma", 1, 0), ("b", "rash", 1, 0)
    ]
    assert got.columns == list(pairs.PAIR_COLUMNS)


def test_stale_versions_and_unmatched_reports_drop(frame):
    demo = [(1, 10, 1, "20230101", "2023Q1"), (2, 10, 2, "20230401", "2023Q2")]
    drug = [(1, "PS", "OLD", "o"), (2, "PS", "NEW", "n"), (9, "PS", "LOST", "l")]
    got = build(frame, demo, drug, [(1, "coma"), (2, "coma"), (9, "coma")])
    assert rows(got, "drug_key", "source_quarter", "lt_flag") == [("new", "2023Q2", 0)]
    assert build(frame, demo, drug, []).count() == 0


def test_bad_dates_become_null(frame):
    got = build(frame, [(1, 1, 1, "2023", "2023Q1")], [(1, "PS", "A", "a")], [(1, "x")])
    assert got.first().fda_dt is None


def test_shards_of_wide_reports_change_nothing(frame):
    rng = random.Random(3)
    demo = [row for n in range(1, 8) for row in one_case(n)]
    drug = [(rng.choice([1, 1, 1, rng.randrange(2, 8)]), "PS", f"D{rng.randrange(60)}", "d") for _ in range(400)]
    reac = [(rng.choice([1, 1, rng.randrange(2, 8)]), f"r{rng.randrange(25)}") for _ in range(200)]
    plain = rows(build(frame, demo, drug, reac))
    assert plain == rows(build(frame, demo, drug, reac, wide_report=7))
    expected = {
        (p, d.lower(), r) for p in range(1, 8)
        for d, r in product({x[2] for x in drug if x[0] == p}, {x[1] for x in reac if x[0] == p})
    }
    assert {(x[0], x[2], x[4]) for x in plain} == expected and len(plain) == len(expected)


def test_salted_look_up_equals_broadcast(frame, spark):
    facts = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 as string)) as k")
    lookup = spark.range(41).selectExpr("if(id = 40, 'hot', cast(id as string)) as k", "cast(id as int) as v")
    assert 0 < estimated_bytes(lookup) < 10_000
    for how in ("left", "inner"):
        assert rows(attach(facts, lookup, ["k"], how, limit=0, salts=4)) == rows(attach(facts, lookup, ["k"], how))
    exploded = lookup.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(1))))
    assert trusted_bytes(exploded) is None  # no estimate sees what an explode makes
    salted = attach(facts, exploded, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in salted and "_salt" in salted
    assert measured_bytes(lookup) >= 32 * lookup.count()
    assert "BroadcastHashJoin" in attach(facts, lookup, ["k"])._jdf.queryExecution().executedPlan().toString()


def random_reports(seed=5):
    """Reports of one to many drugs and reactions, repeated ones and rows without a report among them."""
    rng = random.Random(seed)
    demo = [row for n in range(1, 30) for row in one_case(n)]
    drug = [(rng.choice([None, 1, *range(1, 40)]), "PS", f"D{rng.randrange(9)}", "d") for _ in range(300)]
    reac = [(rng.choice([None, 1, *range(1, 40)]), rng.choice(["r1", " R1 ", "r2", "r3", "", None])) for _ in range(300)]
    return demo, drug, reac


def test_builder_marks_pairs_as_windows_do(frame):
    columns = ("primaryid", "drug_key", "pt", *pairs.MARKS)
    expected = rows(dp.marked(build(frame, *random_reports())), *columns)
    for wide_report in (2048, 5):
        got = build(frame, *random_reports(), marks=True, wide_report=wide_report)
        assert rows(got, *columns) == expected and len(expected) > 100
        assert rows(got, *pairs.PAIR_COLUMNS) == rows(build(frame, *random_reports()))


def test_reports_are_shuffled_once_where_none_is_wide(frame):
    demo, drug, reac = random_reports()
    built = build(frame, demo, drug, reac)
    built.collect()
    plan = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if " Exchange hashpartitioning(" in line]
    assert not any("_shard#" in line for line in shuffles)
    assert len(shuffles) <= 6  # newest version, facts, outcomes, drugs, reactions, and the count of wide reports


def test_task_count_follows_the_files(spark, tmp_path):
    spark.range(200_000).select(F.rand(1).alias("x"), F.rand(2).alias("y")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = estimated_bytes(table)
    crossed = table.crossJoin(table.withColumnsRenamed({"x": "u", "y": "v"}))  # estimated as a product, read as a sum
    least = spark.sparkContext.defaultParallelism
    assert task_count(table) == max(least, -(-size // TASK_BYTES))
    assert task_count(crossed) == max(least, -(-2 * size // TASK_BYTES))


def test_small_name_map_of_a_large_table_is_broadcast(frame, spark, tmp_path):
    raw = spark.range(1_200_000).select(
        F.concat(F.lit("A"), F.col("id") % 5).alias("prod_ai"), F.lit("a").alias("canonical_name"), F.uuid().alias("rxcui")
    )
    raw.write.parquet(str(tmp_path / "map"))
    name_map = naming.load_name_map(spark.read.parquet(str(tmp_path / "map")))
    assert trusted_bytes(name_map) > 32 * 1024 * 1024
    named = naming.normalize(frame([(1, "PS", "A1", "b"), (2, "PS", "Z", "b")], DRUG), name_map)
    assert [r[:2] for r in rows(named)] == [(1, "a"), (2, "z")]
    assert "_salt" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_names(frame):
    drug = frame([(1, "PS", " a ", "x"), (2, "PS", "A", "x"), (3, "PS", None, "x")], DRUG)
    assert rows(naming.distinct_names(drug)) == [("A",)]


def test_name_check(frame):
    expected = frame([("X HCL", "x"), ("GONE", "gone"), ("X HCL", "y")], "raw_name string, expected string")
    assert [r[3] for r in rows(naming.check_names(names(frame), expected))] == [False, True, False]
