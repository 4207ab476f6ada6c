"""The conversion as a stream of files, with first-wins across micro-batches as state of a streaming aggregate."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lociflow.operators import calls
from lociflow.sources import var

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State on the executors' disks, of which a batch reads what it asks for.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def read_stream(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """Lines of the folder's files as they arrive, with what orders them: file and block."""
    reader = spark.readStream.format("text")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered(lines: DataFrame) -> DataFrame:
    """The lines with a number that rises within each task, and so within each block of a file. A streaming plan may not hold
    Spark's own rising ids, so an Arrow step adds a column to whole batches and looks at no row."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(n, n + b.num_rows))], [*b.schema.names, "line"])
            n += b.num_rows

    lines = lines.select("value", "file", "block")
    return lines.mapInArrow(number, "value string, file string, block bigint, line bigint")


def firsts(lines: DataFrame, skip_non_variants: bool = False) -> DataFrame:
    """One row for each key, kept as the stream's state: (kept, key, first, since, until, least, most).

    ``first`` is the key's first row in the order of its batch; ``since`` and ``until`` are the times of the first and the
    last batch that had the key, so a key is new where they are equal; ``least`` and ``most`` are the numbers of fields of
    its rows. Rows that become no record (not ``kept``) share one key without a name: their widths count, too. Tasks
    combine their rows of a key before the shuffle, so that key, and any hot one, travels light.
    """
    order = F.struct("file", "block", "line").alias("ord")
    rows = var.rows(numbered(lines).select(order, "value")).withColumn("width", F.size("cells"))
    typed = calls.decode(rows, None, "width", only=calls.NEEDED, observed=lambda x: x.observe("rows", calls.worst()), every=True)
    kept = F.col("there") & (F.col("ref_allele") != F.col("alt_allele")) if skip_non_variants else F.col("there")
    typed = calls.checked(typed).withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("time", F.current_timestamp())
    rest = [c for c in calls.NEEDED if c not in calls.KEY]
    row = F.struct("ord", "width", F.when(F.col("kept"), F.struct(*rest)).alias("rest"))
    grouped = typed.groupBy("kept", *[F.when(F.col("kept"), F.col(c)).alias(c) for c in calls.KEY])
    return grouped.agg(F.min_by(row, "ord").alias("first"), F.min("time").alias("since"), F.max("time").alias("until"), F.min("width").alias("least"), F.max("width").alias("most"))


def start(lines: DataFrame, folder: str, sample: str, contigs: Sequence[str], skip_non_variants: bool = False, every: str | None = None) -> StreamingQuery:
    """Record lines go to ``folder/records``, a folder for each micro-batch. Without ``every`` the query ends when it has
    processed what has arrived; with it (``10 seconds``) it goes on.

    All rows must have as many fields as the stream's first one; that number is kept in ``folder/width``.

    Rows have no event time, so the keys of all records stay known, each with its first record, in state stores beside the
    checkpoint. A batch looks up its own keys in them and reads nothing else, however long the stream has run. A row whose
    key an earlier batch had is dropped before its sample and contig are checked, as a later duplicate in one file is. A
    batch that is run again begins from the state before it, with the time it had, and overwrites its own folder, so each
    record is written exactly once. The number of state stores is that of shuffle partitions at the stream's first start.
    """
    spark = lines.sparkSession
    names = list(contigs)
    known: list[int] = []

    def width(touched: DataFrame) -> int | None:
        if not known:
            with contextlib.suppress(AnalysisException):  # the stream's first rows
                known.extend(r["width"] for r in spark.read.schema("width int").json(f"{folder}/width").collect())
        if not known and (found := touched.agg(F.min_by("first.width", "first.ord")).first()[0]) is not None:
            spark.createDataFrame([(found,)], "width int").coalesce(1).write.mode("overwrite").json(f"{folder}/width")
            known.append(found)
        return known[0] if known else None

    def batch(touched: DataFrame, number: int) -> None:
        touched = touched.persist()  # the state is read and written once
        try:
            expected = width(touched)
            wrong = touched.agg(F.min(F.when(F.col("least") != expected, F.col("least"))), F.max(F.when(F.col("most") != expected, F.col("most")))).first()
            if found := [w for w in wrong if w is not None]:
                raise ValueError(f"expected {expected} fields, found {found[0]}")
            fresh = touched.where("kept and since = until").select(*calls.KEY, "first.ord", "first.rest.*")
            records = calls.records(calls.of_sample(fresh.withColumn("problem", F.lit(None).cast("string")), sample, names))
            records.select("ord", calls.line().alias("value")).orderBy("ord").select("value").write.mode("overwrite").text(f"{folder}/records/batch={number}")
        finally:
            touched.unpersist()

    with _set(spark, {PROVIDER: ROCKSDB, CHANGELOG: "true"}):
        writer = firsts(lines, skip_non_variants).writeStream.outputMode("update").foreachBatch(batch)
        return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


@contextlib.contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes over when it starts; the session has its own ones again after."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
