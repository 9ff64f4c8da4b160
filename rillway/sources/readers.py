"""Readers of outside systems; they need their connectors on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka(spark: SparkSession, servers: str, topics: list[str], start: str = "latest", committed: bool = True, streaming: bool = True, since_ms: int | None = None) -> DataFrame:
    """value, topic, partition, offset; null and empty values dropped. start: earliest, latest, or JSON offsets; since_ms: a time to start at."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    reader = reader.option("startingTimestamp", str(since_ms)) if since_ms is not None else reader.option("startingOffsets", start)
    if committed:
        reader = reader.option("kafka.isolation.level", "read_committed")
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset").where("value <> ''")


def with_position(records: DataFrame) -> DataFrame:
    """value (a JSON object) with the record's partition and offset put into it; null and empty values dropped.

    The object's text stays as it is, so that numbers and nested values keep their types. A value that is no JSON object is
    passed on unchanged.
    """
    text = F.rtrim("value")
    at = F.format_string('"partition":"%s","offset":"%s"}', F.col("partition").cast("string"), F.col("offset").cast("string"))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    body = F.rtrim(F.substring(text, F.lit(1), F.char_length(text) - 1))
    put = F.concat(body, F.when(body.endswith("{") & (F.ltrim(body) == "{"), "").otherwise(","), at)
    return records.where("value <> ''").select(F.when(is_object, put).otherwise(F.col("value")).alias("value"))


def generated(spark: SparkSession, rows: int, seed: int = 42, per_second: int | None = None) -> DataFrame:
    """A bounded number of made-up rows (id, amount, kind), the same for one seed; with per_second a stream that grows at that rate up to it."""
    ids = spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("id")).where(F.col("id") < rows) if per_second else spark.range(rows)
    roll = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    return ids.select("id", (roll(1, 100_000) / 100).alias("amount"), F.concat(F.lit("kind"), roll(2, 10)).alias("kind"))


def jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A table read in parts of a number column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def folder(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A folder watched as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
