"""Change feeds and dimension building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillway.operators.parsing import prune_map
from rillway.operators.state import latest_by
from rillway.sources.sinks import log_batch, read_log


def normalize(records: DataFrame, databases: list[str] | None = None, tables: list[str] | None = None) -> DataFrame:
    """before/after records (columns before, after maps; source struct<db,table>; op; ts_ms) as database, table, type, data, ts.

    With databases or tables, only theirs.
    """
    for column, wanted in (("source.db", databases), ("source.table", tables)):
        if wanted is not None:
            records = records.where(F.col(column).isin(wanted))
    kind = F.when(F.col("op").isin("r", "c"), "insert").when(F.col("op") == "u", "update").otherwise("delete")
    return records.select(
        F.col("source.db").alias("database"), F.col("source.table").alias("table"), kind.alias("type"),
        F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")).alias("data"), F.col("ts_ms").alias("ts"),
    )


def live(records: DataFrame) -> DataFrame:
    """What a change feed says of rows that still are: key (after.id), op, after, ts; deletes go."""
    return records.where("op <> 'd'").select(F.col("after")["id"].alias("key"), "op", "after", F.col("ts_ms").alias("ts"))


def current_config(changes: DataFrame) -> DataFrame:
    """The control table that a stream of its changes leaves; op d removes a source table."""
    return apply_changes(changes, "source_table", "seq", "op", "d").drop("op", "seq")


def apply_changes(feed: DataFrame, key: str, seq: str, kind: str = "type", delete: str = "delete") -> DataFrame:
    """The table that a feed of upserts and deletes leaves: the last change of each key, deletes gone."""
    return latest_by(feed, [key], [seq]).where(F.col(kind) != delete)


def handover(snapshot: DataFrame, feed: DataFrame, position: int, seq: str = "seq", kind: str = "type", insert: str = "insert") -> DataFrame:
    """A snapshot as inserts, then the changes of the feed behind the position at which it was taken.

    What the feed still holds of before that position is in the snapshot already, and goes; nothing is missed, as the
    feed is read from the position on or from earlier. feed may be a stream, the snapshot's rows then come before it.
    """
    start = snapshot.withColumn(kind, F.lit(insert)).withColumn(seq, F.lit(position).cast(feed.schema[seq].dataType))
    later = feed.where(F.col(seq) > position)
    return later if feed.isStreaming else start.select(*feed.columns).unionByName(later)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], version: str, parts: int | None = None) -> DataFrame:
    """old with the rows of new put in by key; the larger version wins, new on ties. parts is a number of tasks to take instead of the session's."""
    keys = [key] if isinstance(key, str) else key
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    return latest_by(both.repartition(parts, *keys) if parts else both, keys, [version, "_g"]).drop("_g")


def route_dimensions(feed: DataFrame, config: DataFrame) -> DataFrame:
    """Rows of configured source tables with their columns pruned, and where they go.

    config (source_table, sink_table, sink_columns, sink_pk) is a control table of one row a source table. It goes to all tasks: a shuffle by
    the source table would bring a table's changes into one task.
    """
    c = F.broadcast(config.withColumnRenamed("source_table", "table"))
    return feed.join(c, "table").select("sink_table", "sink_pk", "type", prune_map(F.col("data"), F.col("sink_columns")).alias("data"), "seq")


def dimension_rows(routed: DataFrame) -> DataFrame:
    """Routed changes with the value of the key that their sink is keyed by: sink_table, pk, type, data, seq; rows without that value go."""
    return routed.select("sink_table", F.try_element_at("data", F.col("sink_pk")).alias("pk"), "type", "data", "seq").where("pk IS NOT NULL")


def write_dimensions(root: str):
    """For foreachBatch, over dimension_rows: each row put into the table that it names, by its key; a delete stays as a mark, so that an older change that comes late doesn't bring the row back."""
    return log_batch(root, ["sink_table", "pk"], "seq", within=["sink_table"])


def read_dimensions(spark: SparkSession, root: str) -> DataFrame:
    """What the tables under root hold: sink_table, pk, data. A filter on sink_table reads that table's folder alone."""
    rows = read_log(spark, root, StructType.fromDDL("sink_table string, pk string, type string, data map<string,string>, seq bigint"), ["sink_table", "pk"], "seq")
    return rows.where("type <> 'delete'").select("sink_table", "pk", "data")
