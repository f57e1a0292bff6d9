"""JSON messages: one string column `value`, from Kafka or from text files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topic of each entity.
TOPICS = {
    "DEMO": "faers_demo", "DRUG": "faers_drug", "REAC": "faers_reac", "OUTC": "faers_outc",
}


@dataclass(frozen=True)
class EntitySpec:
    """Text fields of a message, the casts applied to them and the required ones."""

    fields: tuple[str, ...]
    casts: dict[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ("primaryid",)

    @property
    def schema(self) -> str:
        return ", ".join(f"{name} string" for name in self.fields)


SPECS = {
    "DEMO": EntitySpec(
        ("primaryid", "caseid", "caseversion", "fda_dt", "source_quarter"),
        {"primaryid": "bigint", "caseid": "bigint", "caseversion": "int"},
        ("primaryid", "caseid"),
    ),
    "DRUG": EntitySpec(
        ("primaryid", "caseid", "role_cod", "prod_ai", "drugname", "source_quarter"),
        {"primaryid": "bigint", "caseid": "bigint"},
    ),
    "REAC": EntitySpec(
        ("primaryid", "pt", "source_quarter"), {"primaryid": "bigint"}, ("primaryid", "pt")
    ),
    "OUTC": EntitySpec(("primaryid", "outc_cod", "source_quarter"), {"primaryid": "bigint"}),
}


def to_messages(df: DataFrame) -> DataFrame:
    """Serialize whole rows; every value is written as text, nulls stay null."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def parse_entity(raw: DataFrame, spec: EntitySpec, period: str | None = None) -> DataFrame:
    """Parse messages as text and cast; unreadable or incomplete ones are dropped.

    Blank text counts as null. A failed cast gives null instead of an error.
    """
    parsed = raw.select(F.from_json("value", spec.schema).alias("m")).select("m.*")
    columns = []
    for name in spec.fields:
        text = F.when(F.trim(name) != "", F.col(name))
        kind = spec.casts.get(name)
        columns.append((F.trim(text).try_cast(kind) if kind else text).alias(name))
    typed = parsed.select(*columns).dropna(subset=list(spec.required))
    return typed.filter(F.col("source_quarter") == period) if period else typed


def first_messages(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first `limit` messages in a fixed order; None is no cap, 0 gives nothing."""
    if limit is not None:
        df = df.orderBy(*order, "value").limit(limit)
    return df.select("value")


def read_text(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Messages from text files, one per line; optionally the first `limit` by value."""
    return first_messages(spark.read.text(path), limit)


def read_topic(
    spark: SparkSession, servers: str, topic: str, limit: int | None = None
) -> DataFrame:
    """Whole Kafka topic as a batch, optionally the oldest `limit` messages.

    Needs the Spark Kafka connector on the class path.
    """
    df = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .option("failOnDataLoss", "false")
        .load()
        .selectExpr("CAST(value AS STRING) AS value", "timestamp", "partition", "offset")
    )
    return first_messages(df, limit, "timestamp", "partition", "offset")


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Publish rows as JSON messages. Needs the Spark Kafka connector on the class path."""
    (
        to_messages(df).write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
