"""Writers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


TASK_ROWS = 250_000  # rows that a task of an upsert sorts, on an average
SALTS = 64  # parts of a folder's rows; small ones are joined again
FOLD_ROWS = 8_000_000  # rows of micro-batches that a table of log_batch holds beside its base, at least


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one, kept while Python runs, only in a session of one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def to_console(df: DataFrame, rows: int = 20):
    """Rows to the console: shown at once, or with each micro-batch."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).outputMode("update").start()
    df.show(rows, truncate=False)


def write_routed(df: DataFrame, sink: str, root: str) -> str:
    """Each row into the folder that one of its columns names. A folder's rows are dealt to as many tasks as they need, by a hash of the row but its maps."""
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.lit(SALTS))
    df.withColumn("_salt", salt).hint("rebalance", sink, "_salt").drop("_salt").write.partitionBy(sink).mode("append").parquet(root)
    return root


def save(df: DataFrame, name: str, mode: str, path: str, by: list[str]) -> None:
    """A catalog table over path, partitioned by columns; mode is append, overwrite, ignore or error."""
    df.write.mode(mode).partitionBy(*by).option("path", path).saveAsTable(name)


def insert(df: DataFrame, name: str, replace: bool = False) -> None:
    """Rows into a partitioned table, by place of the columns; with replace, only the partitions that the rows fall in are replaced."""
    conf, setting = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(setting)
    conf.set(setting, "dynamic")
    try:
        df.write.insertInto(name, overwrite=replace)
    finally:
        conf.set(setting, before)


def write_partitioned(df: DataFrame, by: list[str], path: str, rows_per_file: int = 5_000_000) -> str:
    """Files by the values of some columns. Rebalance splits a value with many rows over tasks and joins small ones, so that none is written by every task."""
    df.hint("rebalance", *by).write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
    return path


def compact(spark: SparkSession, path: str, by: list[str], to: str) -> str:
    """The same rows in fewer files. AQE's rebalance splits large partitions and joins small ones."""
    df = spark.read.parquet(path)
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(to)
    return to


def upsert_batch(path: str, key: str, version: str, within: list[str] = (), buckets: int | None = None, rows_per_bucket: int = 1_000_000):
    """For writeStream.foreachBatch: keep the newest row of each key in a Parquet table that is partitioned by a hash of the key.

    With within, each value of those columns is a table of its own in a folder of its name. A batch reads and replaces only
    the buckets that its keys fall in; running one again changes nothing. A bucket with many rows is written by several tasks.
    The table's first batch, best a snapshot, sets the number of buckets if none is named: one for each rows_per_bucket rows,
    64 at least. The number stands in the folders (of=64/bucket=3) and later writers follow it; rebucket() changes it.
    """
    from rillway.operators.cdc import upsert

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        made = spark.read.schema("of int, bucket int").parquet(path).select("of").first() if there else None
        rows = batch.count()
        of = made[0] if made else buckets or max(64, -(-rows // rows_per_bucket))
        # files know their numbers of rows
        tasks = -(-(rows + (spark.read.parquet(path).count() if made else 0)) // TASK_ROWS)
        new, place = _in_buckets(batch, key, of), [*within, "of", "bucket"]
        touched = new.select(*place).distinct()
        old = spark.read.schema(new.schema).parquet(path).join(touched, place, "left_semi") if made else new.limit(0)
        parts = tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
        newest = upsert(old.select(*new.columns), new, [*within, key], version, parts).hint("rebalance", *place)
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(path)

    return write


def log_batch(path: str, key: list[str], version: str, within: list[str] = (), fold_rows: int | None = None):
    """For writeStream.foreachBatch: a keyed table as a log, of which read_log() gives the newest row of each key.

    A batch is written once into a folder of its number and touches no rows that are there; one that runs again replaces its folder. When
    the batches hold more rows than the base beside them, and fold_rows at least, all are folded to the newest row of each key, the next base: over many
    batches a row is written anew a few times, however large the table is, where upsert_batch() rewrites each bucket that a batch falls in.
    What was folded is deleted after its base is there; rows that stand in both fold to the same. within, columns of the key, are folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, least = batch.sparkSession, fold_rows or FOLD_ROWS

        def put(rows: DataFrame, name: int) -> None:
            rows.withColumn("log", F.lit(name).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*within, "log").parquet(path)

        put(batch, number + 2)  # above zero, as a snapshot may be number -1; bases are below, the later the higher
        held = {r.log: r["count"] for r in spark.read.schema("log bigint").parquet(path).groupBy("log").count().collect()}
        new = sum(n for name, n in held.items() if name > 0)
        if new < least or new < sum(n for name, n in held.items() if name < 0):
            return
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(held.values()) // TASK_ROWS))
        put(read_log(spark, path, batch.schema, key, version, parts), max((name for name in held if name < 0), default=-(1 << 40)) + 1)
        for name in sorted(held):  # the oldest first: what is left of them after an error is newer than what is gone
            old = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *["*"] * len(within), f"log={name}"]))
            files = old.getFileSystem(spark._jsc.hadoopConfiguration())
            for found in files.globStatus(old):
                files.delete(found.getPath(), True)

    return write


def read_log(spark: SparkSession, path: str, schema: StructType, key: list[str], version: str, parts: int | None = None) -> DataFrame:
    """The newest row of each key in a table of log_batch, as it is now; among rows of one version that of the latest batch."""
    from rillway.operators.state import latest_by

    rows = spark.read.schema(StructType([*schema.fields, StructField("log", LongType())])).parquet(path)
    return latest_by(rows.repartition(parts, *key) if parts else rows, key, [version, "log"]).drop("log")


def rebucket(spark: SparkSession, path: str, to: str, key: str, schema: StructType, buckets: int, within: list[str] = ()) -> str:
    """A table of upsert_batch that has outgrown its buckets, with its schema (of, bucket left out), written anew with another number of them."""
    rows = _in_buckets(spark.read.schema(schema).parquet(path).select(*schema.names), key, buckets)
    place = [*within, "of", "bucket"]
    rows.hint("rebalance", *place).write.partitionBy(*place).parquet(to)
    return to


def _in_buckets(df: DataFrame, key: str, of: int) -> DataFrame:
    return df.withColumn("of", F.lit(of)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(of)).cast("int"))


def jdbc_append(df: DataFrame, url: str, table: str, transient: list[str] = (), batch_size: int = 100, **properties: str) -> None:
    """Rows appended in batches, without the columns that are only marks."""
    df.drop(*transient).write.option("batchsize", batch_size).jdbc(url, table, "append", dict(properties))


def jdbc_upsert(url: str, table: str, key: str, version: str, columns: list[str], batch_size: int = 100, **properties: str):
    """For foreachBatch: the newest row of each key, put into a table by MERGE from a staging table that each batch writes anew."""
    from rillway.operators.state import latest_by

    def merge(quote) -> str:
        rest = [quote(c) for c in columns if c != key]
        k, v, every = quote(key), quote(version), [quote(c) for c in columns]
        return (
            f"MERGE INTO {table} t USING {table}_staged s ON t.{k} = s.{k} "
            f"WHEN MATCHED AND s.{v} >= t.{v} THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)} "
            f"WHEN NOT MATCHED THEN INSERT ({', '.join(every)}) VALUES ({', '.join(f's.{c}' for c in every)})"
        )

    def write(batch: DataFrame, number: int) -> None:
        latest_by(batch.select(*columns), [key], [version]).write.option("batchsize", batch_size).jdbc(url, f"{table}_staged", "overwrite", dict(properties))
        jvm = batch.sparkSession._jvm
        with _connection(jvm, url, properties) as connection:
            connection.createStatement().executeUpdate(merge(jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier))

    return write


def jdbc_once(url: str, table: str, query: str, ledger: str = "batches", batch_size: int = 100, **properties: str):
    """For foreachBatch: rows appended exactly once, with the number of their micro-batch in the same transaction.

    Tasks write the rows to a staging table, which holds one micro-batch at a time. One transaction then copies them into the table
    and puts the micro-batch's number into the ledger; a number that is there already means that the rows are too, and nothing is
    written. The ledger, (query, batch), is made at the first call. last_batch() reads where a query stands.
    """

    def write(batch: DataFrame, number: int) -> None:
        jvm = batch.sparkSession._jvm
        quote = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
        with _connection(jvm, url, properties) as connection:
            _ledger(connection, ledger)
            if _booked(connection, ledger, query, number):
                return
        batch.write.option("batchsize", batch_size).jdbc(url, f"{table}_staged", "overwrite", dict(properties))
        columns = ", ".join(map(quote, batch.columns))
        with _connection(jvm, url, properties) as connection:
            if not connection.getMetaData().getTables(None, None, table.upper(), None).next() and not connection.getMetaData().getTables(None, None, table, None).next():
                batch.limit(0).write.jdbc(url, table, "append", dict(properties))
            connection.setAutoCommit(False)
            try:
                # the ledger's row comes first: its key keeps a second writer of the same micro-batch out
                booking = connection.prepareStatement(f"INSERT INTO {ledger} (query, batch) VALUES (?, ?)")
                booking.setString(1, query)
                booking.setLong(2, number)
                booking.executeUpdate()
                connection.createStatement().executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {table}_staged")
                connection.commit()
            except BaseException:
                connection.rollback()
                raise

    return write


def last_batch(spark: SparkSession, url: str, query: str, ledger: str = "batches", **properties: str) -> int | None:
    """The largest number of a query's micro-batches whose rows are written."""
    with _connection(spark._jvm, url, properties) as connection:
        _ledger(connection, ledger)
        asked = connection.prepareStatement(f"SELECT MAX(batch) FROM {ledger} WHERE query = ?")
        asked.setString(1, query)
        found = asked.executeQuery()
        found.next()
        top = found.getLong(1)
        return None if found.wasNull() else top


@contextmanager
def _connection(jvm, url: str, properties: dict[str, str]):
    given = jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        yield connection
    finally:
        connection.close()


def _ledger(connection, ledger: str) -> None:
    there = connection.getMetaData()
    if not any(there.getTables(None, None, name, None).next() for name in (ledger, ledger.upper())):
        connection.createStatement().executeUpdate(f"CREATE TABLE {ledger} (query VARCHAR(200) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (query, batch))")


def _booked(connection, ledger: str, query: str, number: int) -> bool:
    asked = connection.prepareStatement(f"SELECT 1 FROM {ledger} WHERE query = ? AND batch = ?")
    asked.setString(1, query)
    asked.setLong(2, number)
    return asked.executeQuery().next()


def to_kafka(df: DataFrame, servers: str, topic: str | Column, key: str | None = None, checkpoint: str | None = None):
    """Rows as JSON, keyed by a column; topic is a name, or a column that names each row's. Spark delivers at least once: readers fold by key."""
    value = df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), (topic if isinstance(topic, Column) else F.lit(topic)).alias("topic"))
    if df.isStreaming:
        return value.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
    return value.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def text_gzip(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.option("compression", "gzip").text(path)
