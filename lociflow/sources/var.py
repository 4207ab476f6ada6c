"""Readers of call rows and of reference indices."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow import schema
from lociflow.functions import built_once

#: A quote opens a field only at its begin. All repetitions are possessive, which Java runs in a loop: no stack grows with
#: the number of quotes or fields.
OPEN = r'"[^"]*+(?:""[^"]*+)*+'
FIELD = rf'\t({OPEN}"[^\t]*+|[^\t]*+)'
QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*+)\z'
FIELDS = rf'(?:(?:{OPEN}"[^\t]*+|[^"\t][^\t]*+|)\t)*+'
#: Lines at whose end a quoted field is open, where none is at their begin, and where one is.
ENDS_OPEN = rf"^{FIELDS}{OPEN}\z"
STAYS_OPEN = rf'^[^"]*+(?:""[^"]*+)*+(?:"[^\t]*+\t{FIELDS}{OPEN})?+\z'
UNCLOSED = "a quoted field has no end on its line"


def cells(value: Column) -> Column:
    """A row's fields. Empty fields stay empty texts; quotes enclose a field and double inside it."""
    fields = F.regexp_extract_all(F.concat(F.lit("\t"), value), F.lit(FIELD), F.lit(1))
    inside = lambda f: F.concat(F.replace(F.regexp_extract(f, QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(f, QUOTED, 2))
    last = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f)), F.lit('""'), F.lit('"'))
    plain = lambda f: F.when(f.rlike(QUOTED), inside(f)).when(f.startswith('"'), last(f)).otherwise(f)
    return F.when(value.contains('"'), F.transform(fields, plain)).otherwise(F.split(value, "\t", -1))


@built_once
def _cells() -> Column:
    return cells(_ended())


def _ended() -> Column:
    """A line without the carriage return at its end."""
    return F.when(F.col("value").endswith("\r"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value"))


def _lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(ord, value): ord is made of numbers, that of the file among all by path in place of the path, as every shuffled row carries it."""
    read = spark.read.options(**options).text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    # Listed by a reader that names files as the text reader does; their content is not asked for.
    files = sorted(x[0] for x in spark.read.format("binaryFile").load(path).select("_metadata.file_path").collect())
    if len(files) > 1:
        numbers = spark.createDataFrame(list(enumerate(files)), "file int, path string")
        lines = lines.join(F.broadcast(numbers), "path", "left")
        number = F.coalesce("file", F.raise_error(F.concat(F.lit("not listed: "), F.col("path"))).cast("int"))
    else:
        number = F.lit(0)
    return lines.select(F.struct(number.alias("file"), "block", "line").alias("ord"), "value")


def rows(lines: DataFrame, closed: bool = False) -> DataFrame:
    """(ord, cells, fault) of the lines (ord, value) that are not blank: their fields, and why a line cannot be read, null for
    nothing. A line that leaves a quoted field open has the fault UNCLOSED, but not where rows are ``closed`` by now."""
    faults = [F.when(~F.is_valid_utf8("value"), "the text is not valid UTF-8")]
    if not closed:
        faults.append(F.when(F.col("value").contains('"') & F.col("value").rlike(ENDS_OPEN), UNCLOSED))
    return lines.where("value != '' and value != '\r'").select("ord", _cells().alias("cells"), F.coalesce(*faults).alias("fault"))


def read_calls(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """(ord, cells, fault): the rows of a file, or of a folder's files by name, blank lines left out. ord sorts as the input;
    fault says why a row cannot be read, null for nothing.

    Each line is a row, and one that leaves a quoted field open has the fault UNCLOSED. With ``line_breaks`` such a row
    goes on over the next lines (one that nothing closes, to the end of its file).
    """
    if line_breaks:
        return rows(joined(_lines(spark, path, lineSep="\n")), closed=True)
    return rows(_lines(spark, path))


def joined(lines: DataFrame) -> DataFrame:
    """(ord, value): lines put together to rows, where quoted fields hold line breaks.

    Whether a line begins inside a quoted field depends on all lines before it, but only by one bit. A line turns that bit
    into another one: it sets it, keeps it or flips it. A task reads the lines of a block in order, so it can follow the bit
    without a shuffle; a first pass over the turns alone tells for each block what it makes of either bit, where its first row
    begins and which row it leaves open. Blocks, one row each, are composed by a running window. Then a second pass
    puts the rows together that lie within a block, and only lines of rows that go on over a block's end are shuffled to meet.
    """
    c = F.col
    quoted, value = c("value").contains('"'), _ended()
    turned = lines.select("ord", "value", (quoted & value.rlike(ENDS_OPEN)).alias("out"), (~quoted | value.rlike(STAYS_OPEN)).alias("in"))
    known = F.broadcast(_bounds(turned.select("ord", "out", "in").mapInArrow(_turns, TURNS)))
    placed = lambda rows: rows.join(known, (c("ord.file") == c("file")) & (c("ord.block") == c("block")))
    within = (c("ord.line") >= c("first")) & (c("last").isNull() | (c("ord.line") < c("last")))
    ord_type = lines.schema["ord"].dataType.simpleString()
    whole = placed(turned).where(within).select("ord", c("value").cast("binary").alias("value"), "out", "in").mapInArrow(_put_together, f"ord {ord_type}, value binary")
    start = F.when(c("ord.line") >= c("last"), F.struct("file", "block", c("last").alias("line"))).otherwise(c("earlier"))
    parts = placed(lines).where(~F.coalesce(within, F.lit(False))).select(start.alias("ord"), F.struct(c("ord").alias("at"), "value").alias("part"))
    several = parts.groupBy("ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["value"]), "\n").alias("value"))
    return whole.select("ord", c("value").cast("string").alias("value")).union(several)


#: What a block makes of the bit 0 and of the bit 1 that it may begin with: the bit at its end, the first line that begins
#: outside a quoted field, and the last such line.
TURNS = "file int, block bigint, " + ", ".join(f"open{b} boolean, first{b} bigint, last{b} bigint" for b in (0, 1))


def _followed(out: np.ndarray, stays: np.ndarray, begin: bool) -> np.ndarray:
    """Whether lines begin inside a quoted field, and whether the line after them does: one more than there are lines."""
    flips = np.cumsum(out & ~stays)
    last = np.maximum.accumulate(np.where(out == stays, np.arange(len(out)), -1))
    since = np.where(last >= 0, out[last] - flips[last], int(begin)) + flips
    return np.concatenate([[begin], since % 2 == 1])


def _bools(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turn of each block, as TURNS, from its lines (ord, out, in)."""
    at, state = None, None

    def told() -> pa.RecordBatch:
        row = [*at, *(x for s in state for x in s)]
        kinds = [pa.int32(), pa.int64(), *[pa.bool_(), pa.int64(), pa.int64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in TURNS.split(", ")])

    for batch in batches:
        file, block, line = batch.column("ord").flatten()
        out, stays = _bools(batch.column("out")), _bools(batch.column("in"))
        number = line.to_numpy()
        changes = (np.diff(file.to_numpy()) != 0) | (np.diff(block.to_numpy()) != 0)
        edges = [0, *(np.flatnonzero(changes) + 1), len(number)] if len(number) else []
        for i, j in itertools.pairwise(edges):
            here = (file[i].as_py(), block[i].as_py())
            if here != at:
                if at:
                    yield told()
                at, state = here, [[False, None, None], [True, None, None]]
            for s in state:
                inside = _followed(out[i:j], stays[i:j], s[0])
                begins = number[i:j][~inside[:-1]]
                s[0] = bool(inside[-1])
                if len(begins):
                    s[1:] = int(begins[0]) if s[1] is None else s[1], int(begins[-1])
    if at:
        yield told()


def _bounds(turns: DataFrame) -> DataFrame:
    """For each block: the first line that begins a row; the line whose row the block leaves open, null for none; and, as
    ``earlier``, the begin of the row that an earlier block of the file left open."""
    c = F.col
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    keeps, sets = ~c("open0") & c("open1"), c("open0") == c("open1")
    flips = turns.withColumn("_flips", F.coalesce(F.sum((~keeps & ~sets).cast("int")).over(W.partitionBy("file").orderBy("block")), F.lit(0)))
    # The last block before this one that sets the bit, and the flips since then.
    flips = flips.withColumn("_set", F.last(F.when(sets, F.struct(c("open0").cast("int").alias("bit"), "_flips")), ignorenulls=True).over(before)).withColumn("_before", F.coalesce(F.max("_flips").over(before), F.lit(0)))
    begin = (F.coalesce(c("_set.bit"), F.lit(0)) + c("_before") - F.coalesce(c("_set._flips"), F.lit(0))) % 2 == 1
    taken = flips.withColumn("_begin", begin).select("file", "block", *[F.when(c("_begin"), c(f"{x}1")).otherwise(c(f"{x}0")).alias(x) for x in ("open", "first", "last")])
    left = taken.withColumn("last", F.when(c("open"), c("last")))
    return left.select("file", "block", "first", "last", F.last(F.when(c("last").isNotNull(), F.struct("file", "block", c("last").alias("line"))), ignorenulls=True).over(before).alias("earlier"))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, value) of rows from their lines (ord, value, out, in), in order. The first line begins a row and the last ends one."""
    held, rest = None, []

    def full(ords: pa.Array, values: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ords, values], names=["ord", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ords, values = batch.column("ord"), batch.column("value")
        inside = _followed(_bools(batch.column("out")), _bools(batch.column("in")), held is not None)
        starts = np.flatnonzero(~inside[:-1])
        if held is not None:
            # Lines of the row that an earlier batch left open.
            n = starts[0] if len(starts) else len(values)
            rest += values[:n].to_pylist()
            if len(starts) or not inside[-1]:
                yield full(held, pa.array([b"\n".join(rest)], pa.binary()))
                held, rest = None, []
        if inside[-1] and len(starts):
            held, rest = ords.take(starts[-1:]), values[starts[-1] :].to_pylist()
            values, starts = values[: starts[-1]], starts[:-1]
        if len(starts):
            rows = pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)) - starts[0], pa.int32()), values[starts[0] :])
            yield full(ords.take(starts), pc.binary_join(rows, b"\n"))
    if held is not None:
        yield full(held, pa.array([b"\n".join(rest)], pa.binary()))


def first_width(spark: SparkSession, path: str, line_breaks: bool = False) -> int | None:
    """Number of fields of the first row, which all others must have: that of the first file that has rows."""
    for file in sorted(spark.read.text(path).inputFiles()):
        # Spark reads the blocks of one file in order, so its first row comes from its first task.
        row = width(read_calls(spark, unquote(file), line_breaks))
        if row is not None:
            return row
    return None


def width(calls: DataFrame) -> int | None:
    row = calls.select(F.size("cells")).first()
    return row[0] if row else None


def read_index(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and lengths of the contigs of a FASTA index, in its order. It becomes the header, so it comes to the driver."""
    rows = spark.read.csv(path, sep="\t", schema=schema.FAI, mode="FAILFAST", quote="").withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    if any(v is None for r in rows for v in r):
        raise ValueError(f"malformed index: {path}")
    return [(r["name"], r["length"]) for r in rows]


def index_path(fasta: str) -> str:
    return fasta + ".fai"
