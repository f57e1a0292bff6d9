"""Delimited report files, one folder per reporting period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File prefixes of the entities and the period label in a path.
ENTITIES = ("DEMO", "DRUG", "REAC", "OUTC")
PERIOD_PATTERN = r"(\d{4}Q[1-4])"


def _headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Files of the paths (patterns and folders) by their first line.

    The driver opens each file for one line; files are few and large here.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for path in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(path)
        fs = pattern.getFileSystem(conf)
        for top in fs.globStatus(pattern) or []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                file = files.next().getPath()
                if file.getName().startswith(("_", ".")):
                    continue
                stream = jvm.java.io.InputStreamReader(fs.open(file), "ISO-8859-1")
                try:
                    line = jvm.java.io.BufferedReader(stream).readLine()
                finally:
                    stream.close()
                if line:
                    found.setdefault(line, []).append(file.toString())
    return found


def read_files(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """`$`-separated Latin-1 files with a header, all columns as text, tagged with their period.

    A backslash is data here (combination names), so the quote character escapes
    itself. Without a schema every file is read by its own header: columns may differ in
    order and number from file to file, and a column that a file lacks is null.
    """
    if not schema:
        parts = [
            _read(spark, files, None) for _, files in sorted(_headers(spark, [path] if isinstance(path, str) else path).items())
        ]
        if parts:
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part, allowMissingColumns=True)
            return whole
    return _read(spark, path, schema)


def _read(spark: SparkSession, path: str | list[str], schema: str | None) -> DataFrame:
    reader = (
        spark.read.option("sep", "$")
        .option("encoding", "ISO-8859-1")
        .option("header", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
    )
    if schema:
        reader = reader.schema(schema)
    return _with_period(reader.csv(path))


def _with_period(df: DataFrame) -> DataFrame:
    """Tag rows with the period label found in their file's path."""
    label = F.regexp_extract(F.col("_metadata.file_path"), PERIOD_PATTERN, 1)
    return df.withColumn("source_quarter", F.nullif(label, F.lit("")))


def select_periods(
    df: DataFrame, year: str | int | None = None, quarters: Sequence[int] | None = None
) -> DataFrame:
    """Optional selection of a year and of quarter numbers."""
    if year is not None:
        df = df.filter(F.substring("source_quarter", 1, 4) == str(year))
    if quarters is not None:
        number = F.substring_index("source_quarter", "Q", -1).try_cast("int")
        df = df.filter(number.isin([int(q) for q in quarters]))
    return df


def read_reports(
    spark: SparkSession,
    root: str,
    entity: str,
    year: str | int | None = None,
    quarters: Sequence[int] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """All files of one entity under root/<year>/<period>/, tagged with the period.

    Year and entity become part of the path, so other files are never listed or read.
    """
    pattern = f"{root}/{year or '*'}/*/{entity}*.txt"
    return select_periods(read_files(spark, pattern, schema), year, quarters)


def entity_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per entity and period; nothing is published."""
    parts = [
        df.groupBy("source_quarter").agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(entity).alias("entity"), "source_quarter", "n_rows")
        for entity, df in frames.items()
    ]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted


def missing_entities(counts: DataFrame, entities: Sequence[str] = ENTITIES) -> DataFrame:
    """Periods seen for some entity but without rows for another."""
    expected = counts.select("source_quarter").distinct().select(
        "source_quarter", F.explode(F.array(*[F.lit(e) for e in entities])).alias("entity")
    )
    present = counts.filter(F.col("n_rows") > 0).select("entity", "source_quarter")
    return expected.join(present, ["entity", "source_quarter"], "left_anti")


def unpublished(incoming: DataFrame, published: DataFrame, force: bool = False) -> DataFrame:
    """Rows of periods that the target does not hold yet; `force` lets all through."""
    if force:
        return incoming
    seen = published.select("source_quarter").dropna().distinct()
    return incoming.join(seen, "source_quarter", "left_anti")
