"""Helpers shared by the operators: shared scratch space, lineage cuts, word hashing inside tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that setting is missing and the session runs in one process, as in tests, a temporary local folder is made and
    set once. On a cluster it is an error: each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-llm-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later stages restart from there."""
    return Work(df.sparkSession).cut(df, name)


class Work:
    """The scratch tables of one operator: a table written again under its name replaces the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """df written as the result; all other tables go."""
        out = cut(df, name)
        self.drop(*list(self.paths))
        return out


_kept: dict = {}


def kept(name: str, make):
    """What an operator keeps in a Python worker from one task to the next. Another operator's goes first, so that it doesn't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(schema: StructType, fields: str) -> StructType:
    """A schema with more fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word (works on uint64 arrays in place order)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D in one text's UTF-8 bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, from all its bytes and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    out = mix((ends - starts).astype(np.uint64) + _ODD)
    if longest > 64:  # words that long are few: hash eight bytes at a time, on those only
        long = np.flatnonzero(ends - starts > 64)
        import hashlib

        raw = buf.tobytes()
        special = [int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little") for i in long]
    size = np.minimum(ends - starts, 64)
    pad = np.zeros(len(buf) + 8, np.uint8)
    pad[: len(buf)] = buf
    # every 8-byte little-endian word that starts at a byte of the text
    eight = np.lib.stride_tricks.as_strided(pad, shape=(len(buf) + 1, 8), strides=(1, 1)).copy().view("<u8").ravel() if longest > 0 and len(buf) < 4_000_000 else None
    for k in range(0, min(longest, 64), 8):
        live = np.flatnonzero(size > k)
        at = starts[live] + k
        left = np.minimum(size[live] - k, 8).astype(np.uint64)
        if eight is not None:
            chunk = eight[at]
        else:
            chunk = np.zeros(len(at), np.uint64)
            for b in range(8):
                chunk |= pad[at + b].astype(np.uint64) << np.uint64(8 * b)
        keep = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        out[live] = mix(out[live] ^ mix((chunk & keep) + np.uint64(k + 1)))
    if longest > 64:
        out[long] = np.array(special, dtype=np.uint64)
    return out
