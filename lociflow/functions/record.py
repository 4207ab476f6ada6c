"""Column functions from decoded fields to the columns of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of structural variants that get a length and a type; types that count as deletions.
SV_TYPES = ["BND", "CNV", "DEL", "DUP", "INS", "INV"]
DELETIONS = ["Deletion", "DEL"]
GENOTYPE_CUTOFF = 0.25
FORMAT = "GT:AD:DP:VD"


def _float(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def alt(ref_allele: Column, alt_allele: Column) -> Column:
    return F.when(ref_allele == alt_allele, ".").otherwise(alt_allele)


def qual(alt_depth: Column, base_quality_mean: Column) -> Column:
    """Binary logarithm of the depth times the quality, in 32 bits at every step; 0 at depth 0."""
    log2 = _float(_float(F.ln(F.when(alt_depth > 0, alt_depth).cast("double"))) / _float(F.ln(F.lit(2.0))))
    return F.when(alt_depth == 0, _float(0.0)).otherwise(_float(log2 * _float(base_quality_mean)))


def length(start: Column, end: Column, variant_type: Column) -> Column:
    size = (end - start + 1).cast("int")
    return F.when(variant_type.isin(DELETIONS), -size).otherwise(size)


def sv_length(start: Column, end: Column, variant_type: Column) -> Column:
    return F.when(variant_type.isin(SV_TYPES), length(start, end, variant_type))


def sv_type(variant_type: Column) -> Column:
    return F.when(variant_type.isin(SV_TYPES), variant_type)


def genotype(ref_allele: Column, alt_allele: Column, af: Column, cutoff: float = GENOTYPE_CUTOFF) -> Column:
    """Unphased genotype by allele frequency, compared in 32 bits; a frequency that is not a number is 0/0."""
    af = _float(af)
    return F.when((ref_allele == alt_allele) | F.isnan(af), "0/0").when(af > _float(1 - cutoff), "1/1").when(af > _float(cutoff), "0/1").otherwise("0/0")


def allele_depths(ref_forward: Column, ref_reverse: Column, alt_depth: Column) -> Column:
    ref = ref_forward + ref_reverse
    return F.when(alt_depth == 0, F.array(ref)).otherwise(F.array(ref, alt_depth))


def interval(contig: Column, start: Column, end: Column) -> Column:
    """Half-open, from 0."""
    return F.struct(contig.alias("contig"), (start - 1).alias("begin"), end.alias("end"))
