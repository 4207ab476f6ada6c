"""Operators on call rows, in the order in which a conversion applies them."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lociflow import schema
from lociflow.functions import built_once, parse, record
from lociflow.functions.text import general

KEY = ["contig", "start", "ref_allele", "alt_allele"]


def with_reference(calls: DataFrame) -> DataFrame:
    """Rows whose reference field is there and not empty. They alone are decoded and checked."""
    return calls.where(F.coalesce(F.get("cells", F.lit(schema.REF_FIELD)), F.lit("")) != "")


def worst(problem: str = "problem") -> Column:
    """The first row in input order that has a problem, as JSON of (ord, problem): an aggregate to observe."""
    return F.to_json(F.min(F.when(F.col(problem).isNotNull(), F.struct("ord", F.col(problem).alias("problem"))))).alias("worst")


def decode(calls: DataFrame, width: int | None = None, *more: str, only: Sequence[str] | None = None, observed: Callable[[DataFrame], DataFrame] | None = None, every: bool = False) -> DataFrame:
    """Typed fields, and ``problem``: what is wrong with the row, null for nothing. ``more`` columns go along; ``only`` names
    the fields to give, but all are looked at. With ``every``, rows without a reference stay, told by a column ``there``.

    A row that the reader could not take (``fault``), or that has not ``width`` fields, has a problem in any case; other
    rows without a reference are left out unseen. ``observed`` puts an observation on all rows. Spark pushes no filter below
    it, so nothing above makes it decode a row twice, or leave a row out before it is looked at.
    """
    problems = [F.col("fault")] if "fault" in calls.columns else []
    if width is not None:
        problems.append(F.when(F.size("cells") != width, F.concat(F.lit(f"expected {width} fields, found "), F.size("cells").cast("string"))))
    there = F.coalesce(F.get("cells", F.lit(schema.REF_FIELD)), F.lit("")) != ""
    problem = F.coalesce(*problems, F.when(there, _problem()))
    typed = calls.select("ord", *more, *_decoded(tuple(only or [n for n, _ in schema.FIELDS])), problem.alias("problem"), there.alias("there"))
    typed = observed(typed) if observed else typed.observe(Observation(), worst())
    return typed if every else typed.where(passed(F.col("problem").isNotNull() | F.col("there"))).drop("there")


@built_once
def _problem() -> Column:
    return parse.problem(F.col("cells"))


@built_once
def _decoded(only: tuple[str, ...]) -> list[Column]:
    return parse.decoded(F.col("cells"), only)


def passed(condition: Column) -> Column:
    """The condition, for filters of wide rows: as a higher-order function it is no part of whole-stage code, where a row's
    forty columns would be copied by one method, too long for the JVM to compile. Such a filter hands rows on as they are."""
    return F.exists(F.array(condition), lambda x: x)


def checked(typed: DataFrame) -> DataFrame:
    """Fails on a row with a problem. The key's start carries the check, so it cannot be pruned from any later plan."""
    return typed.withColumn("start", F.when(F.col("problem").isNull(), F.col("start")).otherwise(F.raise_error(F.col("problem")).cast("bigint"))).drop("problem")


def variants_only(typed: DataFrame) -> DataFrame:
    """Rows whose alleles differ. Rows with a problem stay for ``checked``, which Spark would else evaluate on what is left."""
    kept = F.col("ref_allele") != F.col("alt_allele")
    return typed.where(F.col("problem").isNotNull() | kept if "problem" in typed.columns else kept)


def first_of_each(typed: DataFrame, key: Sequence[str] = KEY, order: str = "ord", hashed: bool = False) -> DataFrame:
    """The first row of each key, as an aggregate: tasks combine their rows before the shuffle, so hot keys travel light.
    With ``hashed`` the sorts of both steps compare a hash of the key first, a number, and the key's texts only where that is equal,
    and rows carry their order once: ``min_by`` would hold it beside them. All columns must be orderable then."""
    rest = [c for c in typed.columns if c not in key]
    if hashed:
        rest = [order, *[c for c in rest if c != order]]
        first = typed.groupBy(F.hash(*key).alias("_hash"), *key).agg(F.min(F.struct(*rest)).alias("_first"))
    else:
        first = typed.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in typed.columns])


def complaint(sample: str, known: Column) -> Column:
    """What is wrong with a row's sample or contig, the sample first."""
    wrong = F.when(F.col("sample") != sample, F.concat(F.lit(f"Expected sample '{sample}' found '"), F.col("sample"), F.lit("'!")))
    return F.coalesce(wrong, F.when(~known, F.concat(F.lit("Unknown contig: "), F.col("contig"))))


def complaints(typed: DataFrame, sample: str, contigs: DataFrame | Sequence[str]) -> DataFrame:
    """Rows with one more column ``problem``: a sample or contig that is wrong. Contigs are a table of names (in its first
    column), which Spark broadcasts if they are small, or a list: the driver holds that anyway, so it is broadcast at any length,
    and no row is shuffled to meet it."""
    listed = not isinstance(contigs, DataFrame)
    if listed:
        contigs = typed.sparkSession.createDataFrame([(c,) for c in contigs], "name string")
    names = contigs.select(F.col(contigs.columns[0]).alias("_contig")).distinct()
    names = F.broadcast(names) if listed else names
    joined = typed.join(names, F.col("contig") == F.col("_contig"), "left")
    return joined.withColumn("problem", complaint(sample, F.col("_contig").isNotNull())).drop("_contig")


def of_sample(typed: DataFrame, sample: str, contigs: DataFrame | Sequence[str]) -> DataFrame:
    """Fails on a row of another sample, or on a contig that the index does not name."""
    return checked(complaints(typed, sample, contigs))


#: What the columns of a record are made of, and what is checked.
NEEDED = ["sample", "contig", "start", "end", "ref_allele", "alt_allele", "alt_depth", "base_quality_mean", "mean_mismatches_in_reads", "variant_type", "af", "ref_forward", "ref_reverse", "depth"]


def records(typed: DataFrame, *more: str) -> DataFrame:
    """The columns of finished records, typed. ``more`` columns go along."""
    return typed.select("ord", *more, *_record())


@built_once
def _record() -> list[Column]:
    c = F.col
    return [
        c("contig").alias("chrom"),
        c("start").alias("pos"),
        c("ref_allele").alias("ref"),
        record.alt(c("ref_allele"), c("alt_allele")).alias("alt"),
        record.qual(c("alt_depth"), c("base_quality_mean")).alias("qual"),
        c("end").cast("int").alias("end"),
        c("mean_mismatches_in_reads").alias("mean_read_nm"),
        record.sv_length(c("start"), c("end"), c("variant_type")).alias("svlen"),
        record.sv_type(c("variant_type")).alias("svtype"),
        record.genotype(c("ref_allele"), c("alt_allele"), c("af")).alias("gt"),
        record.allele_depths(c("ref_forward"), c("ref_reverse"), c("alt_depth")).alias("ad"),
        c("depth").alias("dp"),
        c("alt_depth").alias("vd"),
    ]


@built_once
def line() -> Column:
    """A record's columns as a line of text."""
    c = F.col
    info = F.concat_ws(";", F.concat(F.lit("END="), c("end")), F.concat(F.lit("MEAN_READ_NM="), general(c("mean_read_nm"))), F.concat(F.lit("SVLEN="), c("svlen")), F.concat(F.lit("SVTYPE="), c("svtype")))
    values = F.concat_ws(":", "gt", F.concat_ws(",", c("ad").cast("array<string>")), "dp", "vd")
    return F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", general(c("qual")), F.lit("."), info, F.lit(record.FORMAT), values)


def convert(calls: DataFrame, sample: str, contigs: DataFrame | Sequence[str], skip_non_variants: bool = False, width: int | None = None) -> DataFrame:
    """Call rows to record columns: skip rows without reference, decode, filter, keep firsts, check, project. Fails on a bad
    row, on one of any if there are several."""
    typed = decode(calls, width, only=NEEDED)
    if skip_non_variants:
        typed = variants_only(typed)
    return records(of_sample(first_of_each(checked(typed), hashed=True), sample, contigs))


class Findings:
    """What a conversion met, known when its result has been computed once."""

    def __init__(self) -> None:
        self.looks: list[tuple[Observation, DataFrame]] = []

    def observed(self, rows: DataFrame) -> DataFrame:
        look = Observation()
        self.looks.append((look, rows))
        return rows.observe(look, worst())

    def problem(self) -> str | None:
        """The message of the first bad row in input order, None for none."""
        found = [json.loads(x) for look, rows in self.looks if (x := _seen(look, rows))]
        return min(((list(r["ord"].values()), r["problem"]) for r in found), default=(None, None))[1]


def _seen(look: Observation, rows: DataFrame) -> str | None:
    try:
        return look.get["worst"]
    except Py4JJavaError:
        # Spark drops what turns out to be empty while it runs, and what was observed there. Nothing is left then, and the
        # look costs a pass of its own.
        return rows.agg(worst()).first()[0]


def convert_noting(calls: DataFrame, sample: str, contigs: DataFrame | Sequence[str], skip_non_variants: bool = False, width: int | None = None) -> tuple[DataFrame, Findings]:
    """The same, but bad rows are left out and noted: the result is good only if there is no problem. A row that is bad by
    its sample or contig counts as what it is only if no earlier row has its key, so both looks give the first bad row."""
    found = Findings()
    typed = decode(calls, width, only=NEEDED, observed=found.observed).where("problem is null").drop("problem")
    if skip_non_variants:
        typed = variants_only(typed)
    owned = found.observed(complaints(first_of_each(typed, hashed=True), sample, contigs))
    return records(owned.where("problem is null")), found
