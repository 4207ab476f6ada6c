"""Headers and sinks of variant records."""

from __future__ import annotations

import contextlib
import logging
import os
import struct
import sys
import threading
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import lociflow
from lociflow.operators.calls import line

#: The header's lines about fields, filters, formats and alleles.
DECLARATIONS = [
    '##INFO=<ID=END,Number=1,Type=Integer,Description="The end location of this variant call.">',
    '##INFO=<ID=MEAN_READ_NM,Number=1,Type=Float,Description="The mean mismatches within all reads that directly support the variant call.">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="The length of structural variant in base pairs of reference genome, if this call is a structural variant.">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="The structural variant type (BND, CNV, DEL, DUP, INS, INV), if this call is a structural variant.">',
    '##FILTER=<ID=PASS,Description="The variant call has passed all filters and may be considered for downstream analysis.">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="The genotype for this sample.">',
    '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="The allelic depths for the REF and ALT alleles.">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="The total allele depth at this location which potentially includes No-calls.">',
    '##FORMAT=<ID=VD,Number=1,Type=Integer,Description="The variant allele depth at this location.">',
    '##ALT=<ID=BND,Description="Region with an identified unambiguous single breakend.">',
    '##ALT=<ID=CNV,Description="Copy number variable region.">',
    '##ALT=<ID=DEL,Description="Deletion relative to the reference.">',
    '##ALT=<ID=DUP,Description="Region of elevated copy number relative to the reference.">',
    '##ALT=<ID=INS,Description="Insertion of novel sequence relative to the reference.">',
    '##ALT=<ID=INV,Description="Inversion of reference sequence.">',
]
COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
#: An empty block ends a block-gzipped file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BGZF_BLOCK = 0xFF00
#: Records after which progress is logged again, and seconds between two looks at them.
PROGRESS, POLL = 100_000, 1.0
log = logging.getLogger("lociflow")


CONTIG = "##contig=<ID=%s,length=%s>"


def contig_line(name: str, length: int) -> str:
    return CONTIG % (name, length)


def contig_column(name: Column, length: Column) -> Column:
    return F.format_string(CONTIG, name, length)


def reference_line(fasta: str) -> str:
    fasta.encode()  # lone surrogates stand for bytes that are not UTF-8
    return f"##reference={fasta}"


def header(sample: str, contigs: Iterable[tuple[str, int]], fasta: str) -> list[str]:
    source = f"##source=lociflow-{lociflow.__version__}"
    return ["##fileformat=VCFv4.2", source, *DECLARATIONS, *[contig_line(*c) for c in contigs], reference_line(fasta), "\t".join([*COLUMNS, sample])]


#: Fixed value: the extension of compressed files.
GZIP_EXTENSION = "gz"


def is_gzip_path(path: str) -> bool:
    """Whether the last extension is gz; a bare name has none."""
    stem, ext = os.path.splitext(os.path.basename(path.rstrip("/")))
    return ext == f".{GZIP_EXTENSION}" and bool(stem)


def lines(records: DataFrame) -> DataFrame:
    """Records as text, in input order. The text is made after the sort, whose sampling runs what is below it twice."""
    return records.orderBy("ord").select(line().alias("value"))


def bgzf(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Block-gzip: gzip members that carry their own size. BGZF_END is to end the file."""
    held = b""
    for chunk in chunks:
        held += chunk
        while len(held) >= BGZF_BLOCK:
            yield _block(held[:BGZF_BLOCK])
            held = held[BGZF_BLOCK:]
    if held:
        yield _block(held)


def _block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def told(before: int, after: int) -> None:
    """Log every further PROGRESS records."""
    for n in range(before // PROGRESS + 1, after // PROGRESS + 1):
        log.info("Processed %d variant records", n * PROGRESS)


class Progress:
    """While it is open, a thread of the driver asks every POLL seconds how many records there are, and logs it."""

    def __init__(self, count: Callable[[], int]) -> None:
        self.count, self.seen, self.closed = count, 0, threading.Event()
        self.thread = threading.Thread(target=self._watch, name="progress", daemon=True)

    def _watch(self) -> None:
        while not self.closed.wait(POLL):
            self._look()

    def _look(self) -> None:
        now = max(self.seen, self.count())
        told(self.seen, now)
        self.seen = now

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        self.closed.set()
        self.thread.join()
        if kind is None:
            self._look()


def rows_out(spark: SparkSession, description: str) -> int:
    """Rows that the tasks of the jobs of this description have written so far."""
    nothing = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, nothing, spark.sparkContext._jvm.java.util.ArrayList())
    every = (stages.apply(i) for i in range(stages.size()))
    return sum(x.outputRecords() for x in every if x.description().isDefined() and x.description().get() == description)


#: Where lines of a file of parts stand: the header, records, and what ends a compressed file.
HEAD, BODY, TAIL = 0, 1, 2
#: The last byte of every block of a block-gzipped file: the high byte of a size below 65,536.
LAST = "\0"
Verify = Callable[[], None]


def to_parts(records: DataFrame, path: str, head: list[str], verify: Verify = lambda: None) -> int:
    """Executors write part files into a folder of any file system, in order, the header first; the number of records.

    The parts joined by name are the file. For a path that ends in .gz they are block-gzipped, each one by itself and named so that
    readers unpack it, and joined they are one valid block-gzipped file. The folder gets its name when all is written and verified;
    nothing is left of a failed job.
    """
    spark, compress = records.sparkSession, is_gzip_path(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staged = where(path.rstrip("/")), where(f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    body = records.select(F.lit(BODY).alias("place"), F.lit(0).alias("n"), "ord", F.lit(None).cast("string").alias("value"), *[c for c in records.columns if c != "ord"])
    others = [(HEAD, x) for x in head] + ([(TAIL, "")] if compress else [])
    others = spark.createDataFrame([(p, i, x) for i, (p, x) in enumerate(others)], "place int, n int, value string").repartition(1)
    both = others.unionByName(body, allowMissingColumns=True)
    seen = Observation()
    # Counted, and made to text, after the sort, whose sampling runs what is below it twice.
    ordered = both.orderBy("place", "n", "ord").observe(seen, F.count_if(F.col("place") == BODY).alias("n"))
    ordered = ordered.select("place", F.when(F.col("place") == BODY, line()).otherwise(F.col("value")).alias("value"))
    packed = spark.sparkContext.accumulator(0)
    writer = (_blocks(ordered, packed) if compress else ordered.select("value")).write
    before = spark.sparkContext.getLocalProperty("spark.job.description")
    name = f"{before or 'records'} {staged.getName()}"
    count = (lambda: packed.value) if compress else (lambda: rows_out(spark, name) - len(head))
    try:
        spark.sparkContext.setLocalProperty("spark.job.description", name)
        with Progress(count):
            (writer.option("lineSep", LAST) if compress else writer).text(staged.toString())
        verify()
        for part in [x.getPath() for x in files.listStatus(staged) if x.getPath().getName().startswith("part-")] if compress else []:
            if not files.rename(part, part.suffix(f".{GZIP_EXTENSION}")):
                raise OSError(f"cannot write {path}")
        if not files.rename(staged, target):
            raise OSError(f"cannot write {path}")
    except BaseException:
        files.delete(staged, True)
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.job.description", before)
    return seen.get["n"]


def _blocks(ordered: DataFrame, packed: Accumulator) -> DataFrame:
    """Lines as blocks without their LAST byte, which the text writer adds as its line end: it takes any bytes, and brings the
    file systems and the commit of Spark's writers with it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = False

        def texts() -> Iterator[bytes]:
            nonlocal ended
            for batch in batches:
                place = batch.column("place").to_numpy()
                ended |= bool((place == TAIL).any())
                packed.add(int((place == BODY).sum()))
                values = batch.column("value").cast(pa.binary()).filter(pa.array(place != TAIL))
                if len(values):
                    yield pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), b"\n")[0].as_py() + b"\n"

        def told(block: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block[:-1]], pa.binary())], names=["value"])

        yield from map(told, bgzf(texts()))
        if ended:
            yield told(BGZF_END)

    return ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))


def to_one(records: DataFrame, path: str, head: list[str], verify: Verify = lambda: None) -> int:
    """One file of any file system, and its number of records, without the driver: executors order, format and compress in
    parallel, and one task streams their chunks into the file. It appears whole or not at all, in place of an older one; a
    path that ends in .gz is block-gzipped.
    """
    spark, gzip = records.sparkSession, is_gzip_path(path)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, staged = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(settings)
    seen, packed = Observation(), spark.sparkContext.accumulator(0)
    ordered = records.orderBy("ord").observe(seen, F.count("*").alias("n")).select(line().alias("value"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            packed.add(len(pdf))
            for chunk in _chunks(pdf["value"], gzip):
                yield pd.DataFrame({"part": [part], "n": [n], "data": [chunk]})
                n += 1

    before = [(-1, i, bytearray(x)) for i, x in enumerate(_chunks(head, gzip))]
    after = [(2**31 - 1, 0, bytearray(BGZF_END[:-1]))] if gzip else []
    ends = spark.createDataFrame(before + after, "part int, n int, data binary")
    chunks = ends.union(ordered.mapInPandas(pack, "part int, n int, data binary"))
    one = chunks.repartition(1).sortWithinPartitions("part", "n").select(F.col("data").cast("string").alias("value"))
    try:
        with Progress(lambda: packed.value):
            one.write.option("lineSep", LAST if gzip else "\n").text(staged.toString())
        verify()
        written = next(x.getPath() for x in files.listStatus(staged) if x.getPath().getName().startswith("part-"))
        rename = getattr(fs, "Options$Rename")
        how = spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(target.getFileSystem(settings).getUri(), settings).rename(written, files.makeQualified(target), how)
    finally:
        files.delete(staged, True)
    return seen.get["n"]


def _chunks(lines: Iterable[str], gzip: bool) -> Iterator[bytes]:
    """Lines as bytes that a text writer ends by the last byte of each chunk."""
    text = "".join(f"{x}\n" for x in lines).encode()
    if gzip:
        yield from (block[:-1] for block in bgzf([text]))
    elif text:
        yield text[:-1]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of part files, header included."""
    return spark.read.text(path)


def _packed(records: DataFrame, gzip: bool, packed: Accumulator) -> DataFrame:
    """(data, n): the records' lines in order, as bytes for a file, compressed by the executors where asked for."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = "".join(f"{x}\n" for x in pdf["value"]).encode()
            packed.add(len(pdf))
            yield pd.DataFrame({"data": [b"".join(bgzf([text])) if gzip else text], "n": [len(pdf)]})

    return lines(records).mapInPandas(pack, "data binary, n bigint")


def _sent(records: DataFrame, out: BinaryIO, head: list[str], gzip: bool, verify: Verify) -> int:
    """Header and packed lines to a stream, one partition at a time; the number of lines. Nothing goes out if a row is bad."""
    packed = records.sparkSession.sparkContext.accumulator(0)
    done = _packed(records, gzip, packed).persist()
    try:
        with Progress(lambda: packed.value):
            done.count()
        verify()
        text = "".join(f"{x}\n" for x in head).encode()
        out.write(b"".join(bgzf([text])) if gzip else text)
        count = 0
        for row in done.toLocalIterator(prefetchPartitions=True):
            out.write(row["data"])
            count += row["n"]
        if gzip:
            out.write(BGZF_END)
        out.flush()
        return count
    finally:
        done.unpersist()


def to_file(records: DataFrame, path: str, head: list[str], verify: Verify = lambda: None) -> int:
    """One local file, and its number of records: for outputs that one disk takes. It appears whole or not at all; a path
    that ends in .gz is block-gzipped."""
    beside = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(beside, "wb") as out:
            count = _sent(records, out, head, is_gzip_path(path), verify)
        os.replace(beside, path)
        return count
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(beside)


def to_stdout(records: DataFrame, path: str | None, head: list[str], verify: Verify = lambda: None) -> int:
    """The same to standard output."""
    return _sent(records, sys.stdout.buffer, head, False, verify)
