"""Queries by name, and the SQL that gives the same rows.

The driver's tables hold no call rows, so each query derives some from ``lineitem``: as decoded columns where an operator
takes those, or as the text cells of a file (``cells``). It applies one operator to all of them, or the whole conversion.
Results are compared row by row: they carry the row's order and line number. The SQL derives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow import schema
from lociflow.convert import convert
from lociflow.functions import parse, record
from lociflow.functions.text import general
from lociflow.operators import calls
from lociflow.sources import var, vcf
from lociflow.sources.shared import scratch

FLAGSHIP = "vcf_line"

LINE_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ROW = ["l_orderkey", "l_linenumber"]


def _text(x: str) -> str:
    return f"cast({x} as varchar(20))"


#: A row's cells by field, as SQL that Spark and DuckDB read alike; every field's kind is met with several values.
CELLS = {
    "sample": "'s1'",
    "interval_name": f"concat('g', {_text('l_orderkey % 50')})",
    "contig": f"concat('chr', {_text('l_suppkey')})",
    "start": _text("l_partkey"),
    "end": _text("l_partkey + l_linenumber - 1"),
    "ref_allele": "substr('ACGT', cast(1 + l_linenumber % 4 as int), 1)",
    "alt_allele": "substr('ACGT', cast(1 + l_orderkey % 4 as int), 1)",
    "depth": _text("cast(l_quantity as int)"),
    "alt_depth": _text("cast(l_quantity as int) % 7"),
    "ref_forward": _text("l_orderkey % 100"),
    "ref_reverse": _text("l_partkey % 100"),
    "alt_forward": _text("l_suppkey % 10"),
    "alt_reverse": _text("l_linenumber"),
    "gt": "'A/T'",
    "af": f"concat('0.', {_text('(l_orderkey * 7 + l_linenumber) % 100')})",
    "strand_bias": f"concat({_text('l_orderkey % 3')}, ';', {_text('l_linenumber % 3')})",
    "mean_position_in_read": f"concat({_text('l_partkey % 70')}, '.5')",
    "stdev_position_in_read": "'1'",
    "base_quality_mean": f"concat({_text('20 + l_orderkey % 20')}, '.', {_text('l_linenumber')})",
    "stdev_base_stdev": "'1'",
    "strand_bias_p_value": f"concat('1e-', {_text('l_linenumber')})",
    "strand_bias_odds_ratio": f"case cast(l_orderkey % 5 as int) when 0 then 'Inf' when 1 then '-Inf' when 2 then '0' when 3 then concat('0.', {_text('1 + l_linenumber')}) else {_text('l_linenumber')} end",
    "mean_mapping_quality": "'60'",
    "signal_to_noise": f"concat({_text('l_orderkey % 9')}, '.25')",
    "af_high_quality_bases": "'0.125'",
    "af_adjusted": "'0'",
    "num_bases_3_prime_shift_for_deletions": _text("l_linenumber % 3 - 1"),
    "microsatellite": "'2.5'",
    "microsatellite_length": "'1'",
    "mean_mismatches_in_reads": f"concat({_text('l_linenumber')}, '.', {_text('(l_orderkey * 13 + l_partkey) % 1000')})",
    "high_quality_variant_reads": _text("l_orderkey % 5"),
    "high_quality_total_reads": "'50'",
    "flank_seq_5_prime": "'ACGT'",
    "flank_seq_3_prime": "''",
    "segment": f"concat('chr1:', {_text('l_partkey')})",
    "variant_type": "case cast(l_orderkey % 8 as int) when 0 then 'SNV' when 1 then 'DEL' when 2 then 'INV' when 3 then 'DUP' when 4 then 'Deletion' when 5 then '' when 6 then 'BND' else 'INS' end",
    "duplication_rate": f"case when l_orderkey % 4 = 0 then '0' else concat('0.', {_text('l_linenumber')}) end",
    "sv_info": f"case cast(l_orderkey % 3 as int) when 0 then '0' when 1 then concat({_text('l_linenumber')}, '-', {_text('l_suppkey % 9')}, '-2') else concat('1-', {_text('l_linenumber')}, '-3-9') end",
    "distance_to_crispr_site": _text("l_suppkey % 100"),
}
#: What stands beside the cells: a reference that may be empty, and a sample that may be another.
MORE = {"empty_ref": "case when l_orderkey % 10 = 0 then '' else 'A' end", "who": "case when l_suppkey % 4 = 0 then 's2' else 's1' end"}
CAST = {"int": "int", "unsigned": "bigint", "float": "float"}
#: The decoded columns that need no parser of their own.
TYPED = {n: f"cast({CELLS[n]} as {CAST[k]})" for n, k in schema.FIELDS if k in CAST}
KEYED = ", ".join(LINE_ITEM)
BASE = f"SELECT {KEYED}, " + ", ".join(f'{v} AS "{k}"' for k, v in (CELLS | TYPED | MORE).items()) + " FROM lineitem"


def _spark(sql: str) -> str:
    return sql.replace("varchar(20)", "string")


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """The table, dealt anew where its files give fewer tasks than there are cores: a small table in one row group."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(*LINE_ITEM)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, *ROW) if rows.rdd.getNumPartitions() < cores else rows


def derived(spark: SparkSession, folder: str, *names: str, ordered: bool = False, dealt: bool = False) -> DataFrame:
    """The named columns of call rows and ROW, plus ``ord``, which puts all columns of lineitem in order, where asked for.
    ``dealt`` is for work that outweighs dealing the rows of one row group to all cores."""
    rows = line_items(spark, folder) if dealt else spark.read.parquet(f"{folder}/lineitem.parquet")
    order = [F.struct(*LINE_ITEM).alias("ord")] if ordered else []
    return rows.select(*ROW, *order, *[F.expr(_spark((CELLS | TYPED | MORE)[n])).alias(n) for n in names])


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as a reader of files gives them: ord and cells."""
    return _cells(line_items(spark, folder))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW, F.struct(*LINE_ITEM).alias("ord"), F.array(*[F.expr(_spark(CELLS[n])) for n, _ in schema.FIELDS]).alias("cells"))


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    """An index of contigs (name, length): one for each supplier."""
    return spark.read.parquet(f"{folder}/supplier.parquet").select(F.concat(F.lit("chr"), F.col("s_suppkey").cast("string")).alias("name"), ((F.col("s_suppkey") + 1) * 1000).alias("length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, sql


def _rows(select: str, where: str = "") -> str:
    return f"WITH t AS ({BASE}) SELECT l_orderkey, l_linenumber, {select} FROM t {where}"


c = F.col

_add("empty_ref_skip", lambda s, d: calls.with_reference(derived(s, d, "contig", "empty_ref").withColumn("cells", F.array(*[F.lit("x")] * schema.REF_FIELD, "empty_ref"))).drop("cells"), _rows("contig, empty_ref", "WHERE empty_ref <> ''"))
_add("skip_non_variants", lambda s, d: calls.variants_only(derived(s, d, "ref_allele", "alt_allele")), _rows("ref_allele, alt_allele", "WHERE ref_allele <> alt_allele"))

FIRSTS = f"""
WITH t AS (SELECT l.*, row_number() OVER (PARTITION BY contig, "start", ref_allele, alt_allele ORDER BY {KEYED}) AS k FROM ({BASE}) l)
"""


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    kept = calls.first_of_each(derived(spark, folder, "contig", "start", "end", "ref_allele", "alt_allele", "alt_depth", "af", ordered=True, dealt=True))
    return kept.select(*ROW, "contig", "start", "end", "ref_allele", "alt_allele", "alt_depth", c("af").cast("double").alias("af"))


_add("dedupe_first", dedupe_first, FIRSTS + 'SELECT l_orderkey, l_linenumber, contig, "start", "end", ref_allele, alt_allele, alt_depth, af::DOUBLE AS af FROM t WHERE k = 1')

SAMPLE_SQL = "CASE WHEN who <> 's1' THEN 'Expected sample ''s1'' found ''' || who || '''!' END"
_add("sample_match", lambda s, d: derived(s, d, "who", "contig").withColumnRenamed("who", "sample").select(*ROW, calls.complaint("s1", F.lit(True)).alias("problem")), _rows(f"{SAMPLE_SQL} AS problem"))


def contig_known(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a row's sample, or with its contig where the index names half of the suppliers."""
    known = contigs(spark, folder).where("substr(name, 4) % 2 = 0").select("name")
    return calls.complaints(derived(spark, folder, "who", "contig").withColumnRenamed("who", "sample"), "s1", known).select(*ROW, "contig", "problem")


_add("contig_known", contig_known, _rows(f"contig, coalesce({SAMPLE_SQL}, CASE WHEN contig NOT IN (SELECT 'chr' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN 'Unknown contig: ' || contig END) AS problem"))


def decode_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of all rows, typed, from their cells; structs as texts, floats as doubles."""
    typed = calls.decode(cells(spark, folder), len(schema.FIELDS), *ROW)
    shown = {"pair": lambda x: parse.show_pair_bias(x), "sv": lambda x: F.when(x.isNotNull(), parse.show_sv_info(x)), **{k: lambda x: x.cast("double") for k in ("float", "odds", "rate")}}
    return typed.select(*ROW, *[shown.get(k, lambda x: x)(c(n)).alias(n) for n, k in schema.FIELDS], "problem")


ODDS_SQL = "CASE {x} WHEN 'Inf' THEN 0 WHEN '-Inf' THEN '-Infinity'::DOUBLE ELSE CAST(CASE WHEN {x}::FLOAT > 0 AND {x}::FLOAT < 1 THEN 1::FLOAT / {x}::FLOAT ELSE {x}::FLOAT END AS DOUBLE) END"
BIAS_SQL = "CASE split_part({x}, ';', {i}) WHEN '0' THEN 'TooFewReads' WHEN '1' THEN 'Detected' WHEN '2' THEN 'UnDetected' END"
PAIR_SQL = f"{BIAS_SQL.format(x='strand_bias', i=1)} || ':' || {BIAS_SQL.format(x='strand_bias', i=2)}"
RATE_SQL = "CASE WHEN duplication_rate <> '0' THEN duplication_rate::FLOAT::DOUBLE END"
DECODED_SQL = {
    "text": '"{n}"', "int": '"{n}"', "unsigned": '"{n}"', "float": '"{n}"::DOUBLE', "odds": ODDS_SQL.format(x='"{n}"'), "pair": PAIR_SQL, "rate": RATE_SQL,
    "sv": "CASE WHEN sv_info <> '0' THEN regexp_extract(sv_info, '^[0-9]+-[0-9]+-[0-9]+') END", "optional": '"{n}"::INT',
}
_add("decode_rows", decode_rows, _rows(", ".join(f'{DECODED_SQL[k].replace("{n}", n)} AS "{n}"' for n, k in schema.FIELDS) + ", NULL::VARCHAR AS problem"))


def short_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that lack some of their last fields, or all that may be missing: these are null, and no problem."""
    rows = cells(spark, folder).withColumn("cells", F.slice("cells", F.lit(1), (schema.REQUIRED + c("l_orderkey") % 4).cast("int")))
    typed = calls.decode(rows, None, *ROW)
    sv = F.when(c("sv_info").isNotNull(), parse.show_sv_info(c("sv_info")))
    return typed.select(*ROW, "variant_type", c("duplication_rate").cast("double").alias("duplication_rate"), sv.alias("sv_info"), "distance_to_crispr_site", "problem")


LAST_SQL = {n: f'CASE WHEN l_orderkey % 4 > {i} THEN {DECODED_SQL[k].replace("{n}", n)} END AS "{n}"' for i, (n, k) in enumerate(schema.FIELDS[schema.REQUIRED :])}
_add("short_rows", short_rows, _rows(f"variant_type, {', '.join(LAST_SQL.values())}, NULL::VARCHAR AS problem"))

_add("pos_end", lambda s, d: calls.records(derived(s, d, *calls.NEEDED, ordered=True), *ROW).select(*ROW, "chrom", "pos", c("end").alias("end_pos")), _rows('contig AS chrom, "start" AS pos, CAST("end" AS INT) AS end_pos'))
_add("alt_for_vcf", lambda s, d: derived(s, d, "ref_allele", "alt_allele").withColumn("alt", record.alt(c("ref_allele"), c("alt_allele"))), _rows("ref_allele, alt_allele, CASE WHEN ref_allele = alt_allele THEN '.' ELSE alt_allele END AS alt"))
QUAL_SQL = "CASE WHEN alt_depth = 0 THEN 0.0::FLOAT ELSE (ln(alt_depth::DOUBLE)::FLOAT / ln(2.0::DOUBLE)::FLOAT)::FLOAT * base_quality_mean END"
_add("qual", lambda s, d: derived(s, d, "alt_depth", "base_quality_mean", dealt=True).select(*ROW, general(record.qual(c("alt_depth"), c("base_quality_mean"))).alias("qual")), _rows(f"printf('%g', ({QUAL_SQL})::DOUBLE) AS qual"))
_add("mean_read_nm", lambda s, d: derived(s, d, "mean_mismatches_in_reads", dealt=True).select(*ROW, general(c("mean_mismatches_in_reads")).alias("mean_read_nm")), _rows("printf('%g', mean_mismatches_in_reads::DOUBLE) AS mean_read_nm"))
SVLEN_SQL = """CASE WHEN variant_type IN ('BND', 'CNV', 'DEL', 'DUP', 'INS', 'INV') THEN CASE WHEN variant_type IN ('Deletion', 'DEL') THEN -1 ELSE 1 END * CAST("end" - "start" + 1 AS INT) END"""
SVTYPE_SQL = "CASE WHEN variant_type IN ('BND', 'CNV', 'DEL', 'DUP', 'INS', 'INV') THEN variant_type END"
_add(
    "svlen_svtype",
    lambda s, d: derived(s, d, "start", "end", "variant_type").select(*ROW, record.sv_length(c("start"), c("end"), c("variant_type")).alias("svlen"), record.sv_type(c("variant_type")).alias("svtype"), record.length(c("start"), c("end"), c("variant_type")).alias("length")),
    _rows(f"""{SVLEN_SQL} AS svlen, {SVTYPE_SQL} AS svtype, CASE WHEN variant_type IN ('Deletion', 'DEL') THEN -1 ELSE 1 END * CAST("end" - "start" + 1 AS INT) AS length"""),
)
GT_SQL = "CASE WHEN ref_allele = alt_allele OR isnan(af) THEN '0/0' WHEN af > 0.75::FLOAT THEN '1/1' WHEN af > 0.25::FLOAT THEN '0/1' ELSE '0/0' END"
_add("gt", lambda s, d: derived(s, d, "ref_allele", "alt_allele", "af").select(*ROW, record.genotype(c("ref_allele"), c("alt_allele"), c("af")).alias("gt")), _rows(f"{GT_SQL} AS gt"))
AD_SQL = "CASE WHEN alt_depth = 0 THEN CAST(ref_forward + ref_reverse AS VARCHAR) ELSE (ref_forward + ref_reverse) || ',' || alt_depth END"
_add("ad", lambda s, d: derived(s, d, "ref_forward", "ref_reverse", "alt_depth").select(*ROW, F.concat_ws(",", record.allele_depths(c("ref_forward"), c("ref_reverse"), c("alt_depth")).cast("array<string>")).alias("ad")), _rows(f"{AD_SQL} AS ad"))
_add("dp_vd", lambda s, d: calls.records(derived(s, d, *calls.NEEDED, ordered=True), *ROW).select(*ROW, "dp", "vd"), _rows("depth AS dp, alt_depth AS vd"))
_add("interval_half_open", lambda s, d: derived(s, d, "contig", "start", "end").select(*ROW, record.interval(c("contig"), c("start"), c("end")).alias("i")).select(*ROW, "i.contig", c("i.begin").alias("range_begin"), c("i.end").alias("range_end")), _rows('contig, "start" - 1 AS range_begin, "end" AS range_end'))
_add("odds_ratio", lambda s, d: derived(s, d, "strand_bias_odds_ratio").select(*ROW, parse.odds_ratio(c("strand_bias_odds_ratio")).cast("double").alias("ratio")), _rows(f"{ODDS_SQL.format(x='strand_bias_odds_ratio')} AS ratio"))
_add(
    "sv_info",
    lambda s, d: derived(s, d, "sv_info").select(*ROW, parse.sv_info(c("sv_info")).alias("i")).select(*ROW, "i.*"),
    _rows(", ".join(f"CASE WHEN sv_info <> '0' THEN split_part(sv_info, '-', {i})::INT END AS supporting_{n}" for i, n in enumerate(("split_reads", "pairs", "clusters"), 1))),
)
_add("dup_rate", lambda s, d: derived(s, d, "duplication_rate").select(*ROW, parse.duplication_rate(c("duplication_rate")).cast("double").alias("value")), _rows(f"{RATE_SQL} AS value"))
_add("pair_bias", lambda s, d: derived(s, d, "strand_bias").select(*ROW, parse.show_pair_bias(parse.pair_bias(c("strand_bias"))).alias("shown")), _rows(f"{PAIR_SQL} AS shown"))

LINE_SQL = f"""contig || chr(9) || "start" || chr(9) || '.' || chr(9) || ref_allele || chr(9) || alt_allele || chr(9) || printf('%g', ({QUAL_SQL})::DOUBLE) || chr(9) || '.' || chr(9)
  || 'END=' || "end" || ';MEAN_READ_NM=' || printf('%g', mean_mismatches_in_reads::DOUBLE) || coalesce(';SVLEN=' || ({SVLEN_SQL}) || ';SVTYPE=' || ({SVTYPE_SQL}), '') || chr(9) || 'GT:AD:DP:VD' || chr(9)
  || {GT_SQL} || ':' || {AD_SQL} || ':' || depth || ':' || alt_depth"""
VARIANT_SQL = f"""
WITH v AS (SELECT l.*, row_number() OVER (PARTITION BY contig, "start", ref_allele, alt_allele ORDER BY {KEYED}) AS k FROM ({BASE}) l WHERE ref_allele <> alt_allele)
"""


def vcf_line(spark: SparkSession, folder: str) -> DataFrame:
    """The whole conversion of variants, from text cells to finished lines: decode, filter, firsts, checks, projection."""
    out = calls.convert(cells(spark, folder), "s1", contigs(spark, folder).select("name"), skip_non_variants=True, width=len(schema.FIELDS))
    return out.select("chrom", "pos", calls.line().alias("line"))


_add("vcf_line", vcf_line, VARIANT_SQL + f'SELECT contig AS chrom, "start" AS pos, {LINE_SQL} AS line FROM v WHERE k = 1')


def convert_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written as compressed text files and converted from there to block-gzipped part files: every line of the result."""
    work = scratch(spark)
    # The columns of lineitem are sorted, not the longer lines made of them: the sort's sampling runs what is below it twice.
    ordered = spark.read.parquet(f"{folder}/lineitem.parquet").select(*LINE_ITEM).orderBy(*LINE_ITEM)
    lines = _cells(ordered).select(F.array_join("cells", "\t").alias("value"))
    # A file is a task of the sort, so no reader misses that such files cannot be split.
    lines.write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).text(f"{work}/calls")
    contigs(spark, folder).select(F.concat_ws("\t", "name", c("length").cast("string"), F.lit("0"), F.lit("60"), F.lit("61")).alias("value")).write.text(f"{work}/ref.fa.fai")
    convert(spark, f"{work}/calls", f"{work}/vcf.gz", f"{work}/ref.fa", "s1", skip_non_variants=True, parts=True)
    return vcf.read_lines(spark, f"{work}/vcf.gz").select(F.regexp_replace("value", "^##reference=.*/", "##reference=").alias("line"))


_add(
    "convert_file",
    convert_file,
    VARIANT_SQL + f"SELECT {LINE_SQL} AS line FROM v WHERE k = 1 UNION ALL SELECT '##contig=<ID=chr' || s_suppkey || ',length=' || ((s_suppkey + 1) * 1000) || '>' FROM supplier UNION ALL SELECT unnest(["
    + ", ".join("'" + x.replace("'", "''") + "'" for x in vcf.header("s1", [], "ref.fa")) + "])",
)
#: Fields that need quotes, or look as if they did, as SQL that Spark and DuckDB read alike.
HARD = {
    "plain": _text("l_orderkey * 10 + l_linenumber"),
    "quotes": "concat(chr(34), l_returnflag, chr(34), chr(34), l_linestatus, chr(34))",
    "tabs": f"concat(l_returnflag, chr(9), {_text('l_partkey')}, chr(9))",
    "breaks": f"case when l_orderkey % 3 = 0 then concat(l_linestatus, chr(10), chr(10), chr(34), chr(10), {_text('l_suppkey')}) else {_text('l_partkey')} end",
    "empty": "''",
    "inner": "concat('a', chr(34), 'b', l_returnflag)",
}


def quoted_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose quoted fields hold quotes, tabs and line breaks, written as text files and read back."""
    path = f"{scratch(spark)}/quoted"
    quoted = [x if n in ("plain", "empty", "inner") else f"concat(chr(34), replace({x}, chr(34), concat(chr(34), chr(34))), chr(34))" for n, x in HARD.items()]
    line_items(spark, folder).select(F.concat_ws("\t", *[F.expr(_spark(x)) for x in quoted])).write.text(path)
    rows = var.read_calls(spark, path, line_breaks=True)
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(HARD)], F.size("cells").alias("fields"), "fault")


_add("quoted_file", quoted_file, f"SELECT {', '.join(f'{x} AS {n}' for n, x in HARD.items())}, {len(HARD)} AS fields, NULL::VARCHAR AS fault FROM lineitem")
_add("contig_header", lambda s, d: contigs(s, d).select(vcf.contig_column(c("name"), c("length")).alias("header")), "SELECT '##contig=<ID=chr' || s_suppkey || ',length=' || ((s_suppkey + 1) * 1000) || '>' AS header FROM supplier")
_add("processed_count", lambda s, d: calls.convert(cells(s, d), "s1", contigs(s, d).select("name"), width=len(schema.FIELDS)).agg(F.count(F.lit(1)).alias("processed")), FIRSTS + "SELECT count(*) AS processed FROM t WHERE k = 1")
