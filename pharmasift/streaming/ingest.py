"""New report files are picked up once; the newest case version is kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pharmasift.operators.cases import latest_version
from pharmasift.sources.messages import EntitySpec, parse_entity
from pharmasift.sources.tables import BUCKET, BUCKETS, upsert_into


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of message files appearing in a folder."""
    return spark.readStream.format("text").load(path)


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Stream of a Kafka topic. Needs the Spark Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .selectExpr("CAST(value AS STRING) AS value")
    )


def ingest_available(
    messages: DataFrame, spec: EntitySpec, target: str, checkpoint: str
) -> StreamingQuery:
    """Parse and append everything not ingested yet, then stop.

    The checkpoint remembers consumed files or offsets; the parquet sink commits each
    batch once. The table is partitioned by period, so period filters prune files.
    """
    return (
        parse_entity(messages, spec)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("source_quarter")
        .trigger(availableNow=True)
        .start()
    )


def track_versions(demo_stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep what `current_versions` needs to know about the stream, then stop.

    Each micro-batch is reduced to its newest version per case and stored under its
    own batch number. A batch that is run again after a failure overwrites exactly
    what it wrote before, and stored batches are never rewritten, so the cost of a
    batch depends on the batch alone.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_version(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        demo_stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_by_case(demo_stream: DataFrame) -> DataFrame:
    """The newest version per case as a stateful streaming aggregate; its state store holds one row per case."""
    return latest_version(demo_stream)


def keep_versions(demo_stream: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a table of one row per case up to date with everything not seen yet, then stop.

    The aggregate emits the cases a batch changed (update mode), which are upserted into their hash buckets: the
    table stays one row per case, however many batches there were. After a restart the state comes from the
    checkpoint; a batch run again upserts the same rows.
    """

    def store(batch: DataFrame, _batch_id: int) -> None:
        upsert_into(batch, target, ["caseid"], ["caseversion", "primaryid"], buckets)

    return (
        newest_by_case(demo_stream).writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_versions(spark: SparkSession, target: str) -> DataFrame:
    """The table that `keep_versions` keeps."""
    return spark.read.parquet(target).drop(BUCKET)


def current_versions(spark: SparkSession, target: str) -> DataFrame:
    """Newest version per case over all stored batches; late lower versions lose."""
    return latest_version(spark.read.parquet(target).drop("batch_id"))
