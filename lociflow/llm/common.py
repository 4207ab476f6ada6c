"""What the operators share: scratch tables in the cluster's shared folder, sums of count vectors, tables of a data folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers in one row of a count vector that is being added up.
CHUNK = 1 << 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A local session without one gets a
    temporary folder; on a cluster that is an error, as executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lociflow-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders of scratch tables: those of no ``swept``, then those of each one that is open.
_scratch: list[list[str]] = [[]]


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written inside go at the end, but for lasting ones."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs no recomputation. Spark
    also splits the hot keys of a join with it, which it cannot do with the result of an aggregate. A lasting table
    outlives the innermost ``swept``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lociflow/{uuid.uuid4().hex}"
    _scratch[-2 if lasting and len(_scratch) > 1 else -1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(text: Column) -> Column:
    """What equal texts share; null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string")) % n


def sampled(rows: DataFrame, group: str, item: str, k: int, **kept: Column) -> DataFrame:
    """(group, item, ``kept``): of each group the k different items of smallest hash, one row each; all if there are fewer.

    ``kept`` are aggregates over the rows of an item. The bound holds however often an item repeats and however many
    there are: an approximate count of items only sets a cut on the hash, at about twice the bound, that spares the rest
    the shuffle. Groups are few: their counts come to the driver.
    """
    place = F.xxhash64(item)
    once = lambda df: df.groupBy(group, item).agg(*[c.alias(n) for n, c in kept.items()]) if kept else df.select(group, item).distinct()
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(item, 0.03).alias("n")).collect()
    if not sizes:
        return once(rows)
    cuts = [(r[group], -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * min(1.0, 2 * k / max(r["n"], 1))))) for r in sizes]
    cuts = rows.sparkSession.createDataFrame(cuts, f"{group} {rows.schema[group].dataType.simpleString()}, cut long")
    few = rows.join(F.broadcast(cuts), group).where(place <= F.col("cut"))
    one = once(few).withColumn("_place", place)
    order = W.partitionBy(group).orderBy("_place", item)
    return one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n", "_place")


def vector_sums(rows: DataFrame, count: Callable[[Iterator[pd.DataFrame]], dict[str, np.ndarray]], size: int, kind: type = np.float64, merge: np.ufunc = np.add) -> dict[str, np.ndarray]:
    """Add up (or merge otherwise) one vector per key over all partitions.

    ``count`` sees a partition's batches and gives its vector for each key. The vectors travel in compressed chunks that
    Spark merges in two steps (some tasks together, then all), so no task gets more than a bounded part of them. Only the
    finished vectors, whose size the model fixes, come to the driver.
    """

    def pack(part: np.ndarray) -> bytes:
        return zlib.compress(part.astype(kind).tobytes(), 1)

    def unpack(part: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(part), kind)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId() % 32
        for key, vector in count(batches).items():
            for k in range(0, size, CHUNK):
                part = vector[k : k + CHUNK]
                if part.any():
                    yield pd.DataFrame({"key": [key], "chunk": [k], "salt": [salt], "part": [pack(part)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = unpack(pdf["part"].iloc[0]).copy()
        for part in pdf["part"].iloc[1:]:
            merge(total, unpack(part), out=total)
        return pdf.iloc[:1].assign(part=[pack(total)])

    columns = "key string, chunk int, salt int, part binary"
    parts = rows.mapInPandas(emit, columns)
    for by in (["key", "chunk", "salt"], ["key", "chunk"]):
        parts = parts.groupBy(*by).applyInPandas(add, columns)
    out: dict[str, np.ndarray] = {}
    for row in parts.toLocalIterator():
        part = unpack(row["part"])
        out.setdefault(row["key"], np.zeros(size, kind))[row["chunk"] : row["chunk"] + len(part)] = part
    return out
