"""Operators and the conversion on small, made-up calls."""

import gzip
import io
import math
import os

import pytest
from pyspark.sql import functions as F

from lociflow import schema
from lociflow.convert import convert, main
from lociflow.functions import parse, record
from lociflow.functions.text import general
from lociflow.operators import calls
from lociflow.sources import var, vcf

SAMPLE = "tumor1"


def row(contig="chr1", start=100, end=100, ref="A", alt="T", depth=50, vd=2, rf=20, rr=28, af="0.5", bias="2;2", bq="30", odds="1", nm="1.5", kind="SNV", rate="0", sv="0", sample=SAMPLE, width=38):
    cells = [sample, "gene", contig, start, end, ref, alt, depth, vd, rf, rr, 1, 1, "A/T", af, bias, "10", "1", bq, "1", "0.5", odds, "60", "4", "0.1", "0", "0", "0", "1", nm, "2", "50", "ACGT", "TTTT", "chr1:1-1000", kind, rate, sv, "7"]
    return "\t".join(map(str, cells[:width]))


@pytest.fixture
def files(tmp_path):
    (tmp_path / "ref.fa.fai").write_text("chr1\t1000\t5\t60\t61\nchr2\t500\t1100\t60\t61\n")

    def run(spark, *rows, target="out.vcf", **more):
        (tmp_path / "in.var").write_text("".join(r + "\n" for r in rows))
        n = convert(spark, str(tmp_path / "in.var"), str(tmp_path / target), str(tmp_path / "ref.fa"), SAMPLE, **more)
        data = (tmp_path / target).read_bytes()
        text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
        body = [x.split("\t") for x in text.splitlines() if not x.startswith("#")]
        assert n == len(body)
        return text, body

    run.folder = tmp_path
    return run


def test_header_and_plain_row(spark, files):
    text, body = files(spark, row())
    head = [x for x in text.splitlines() if x.startswith("#")]
    assert head[0] == "##fileformat=VCFv4.2" and head[-1].split("\t")[-1] == SAMPLE
    assert head[-4:-2] == ["##contig=<ID=chr1,length=1000>", "##contig=<ID=chr2,length=500>"] and head[-2] == f"##reference={files.folder}/ref.fa"
    assert len(head) == 2 + 15 + 2 + 1 + 1
    assert body == [["chr1", "100", ".", "A", "T", "30", ".", "END=100;MEAN_READ_NM=1.5", "GT:AD:DP:VD", "0/1:48,2:50:2"]]


def test_order_structural_types_and_reference_rows(spark, files):
    _, body = files(spark, row("chr2", 9, 20, "A", "<DEL>", kind="DEL", sv="1-2-3"), row("chr1", 5, 6, ref="AC", alt="A", kind="Deletion"), row(start=7, alt="A", vd=0, af="0"), row(start=8, alt="G", vd=0, kind="INV", end=10))
    assert [b[0:2] for b in body] == [["chr2", "9"], ["chr1", "5"], ["chr1", "7"], ["chr1", "8"]]
    assert body[0][7].endswith("SVLEN=-12;SVTYPE=DEL") and "SV" not in body[1][7] and body[3][7].endswith("SVLEN=3;SVTYPE=INV")
    assert body[2][4] == "." and body[2][9] == "0/0:48:50:0" and body[3][9] == "0/1:48:50:0" and body[3][5] == "0"


def test_first_of_duplicates_wins_even_over_a_wrong_sample(spark, files):
    _, body = files(spark, row(end=120, depth=9), row(end=130, sample="other"), row(start="0100"))
    assert len(body) == 1 and body[0][7].startswith("END=120") and body[0][9].split(":")[2] == "9"


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([row(sample="other")], "Expected sample 'tumor1' found 'other'!"),
        ([row("chr9")], "Unknown contig: chr9"),
        ([row("chr9", sample="other")], "Expected sample"),
        ([row(bias="1")], "strand_bias"),
        ([row(bias="3;0")], "strand_bias"),
        ([row(bias="1;1;1")], "strand_bias"),
        ([row(sv="0-0")], "sv_info"),
        ([row(sv="-1-1-1")], "sv_info"),
        ([row(depth=" 5")], "depth"),
        ([row(af="1.0f")], "(af)"),
        ([row(rate="")], "duplication_rate"),
        ([row(start=-1)], "start"),
        ([row(), row(start=5, width=37)], "expected 38 fields, found 37"),
        ([row(), row(start=1, depth="x"), row(start=2, bias="9;9")], "depth"),
    ],
)
def test_bad_rows_fail_and_leave_no_file(spark, files, rows, message):
    with pytest.raises(ValueError, match=".*") as error:
        files(spark, *rows)
    assert message in str(error.value)
    assert not (files.folder / "out.vcf").exists()


def test_rows_without_reference_are_not_checked(spark, files):
    text, body = files(spark, row(ref="", alt="", bias="0", sample="other", contig="chrX"))
    assert body == [] and "#CHROM" in text


def test_empty_input_has_a_header(spark, files):
    text, body = files(spark)
    assert body == [] and text.count("\n") == 21


def test_non_variants_are_skipped_but_still_decoded(spark, files):
    _, body = files(spark, row(alt="A", sample="other"), row(), skip_non_variants=True)
    assert [b[4] for b in body] == ["T"]
    with pytest.raises(ValueError, match="depth"):
        files(spark, row(alt="A", depth="x"), skip_non_variants=True)


@pytest.mark.parametrize("width", [36, 37, 38, 39])
def test_trailing_fields_may_be_missing(spark, files, width):
    assert len(files(spark, row(width=width))[1]) == 1


def test_quoted_fields_and_accepted_numbers(spark, files):
    _, body = files(spark, row(sv="1-1-1-9", odds="-Inf", nm="1e-7").replace("gene", '"ge""ne\t2"'), row(start="+7", odds="nan"))
    assert [b[1] for b in body] == ["100", "7"] and "MEAN_READ_NM=1e-07" in body[0][7]


def test_block_gzip(spark, files):
    files(spark, *[row(start=i) for i in range(1, 900)], target="out.vcf.gz")
    data = (files.folder / "out.vcf.gz").read_bytes()
    assert data[:4] == b"\x1f\x8b\x08\x04" and data[12:14] == b"BC" and data.endswith(vcf.BGZF_END)


def test_gzip_paths():
    assert [vcf.is_gzip_path(p) for p in ("a.gz", "a.vcf.gz", "gz", ".gz", "a.gzip", "a.GZ")] == [True, True, False, False, False, False]


def test_modes(spark, files):
    with pytest.raises(ValueError, match="unsupported mode"):
        files(spark, row(), mode="Paired")


@pytest.mark.parametrize(("af", "gt"), [("0.25", "0/0"), ("0.75", "0/1"), ("0.75000001", "0/1"), ("0.7500001", "1/1"), ("NaN", "0/0"), ("0.2500001", "0/1"), ("1", "1/1")])
def test_genotype_borders(spark, af, gt):
    df = spark.createDataFrame([(af,)], "af string").select(record.genotype(F.lit("A"), F.lit("T"), parse.real(F.col("af"))).alias("g"))
    assert df.first().g == gt


def test_qual_in_32_bits(spark):
    import numpy as np

    rows = [(d, q) for d in (0, 1, 2, 3, 7, 100, 12345) for q in (30.0, 37.5, 90.0)]
    df = spark.createDataFrame(rows, "d int, q float").select("d", "q", record.qual(F.col("d"), F.col("q")).alias("x"))
    for r in df.collect():
        want = np.float32(0) if r.d == 0 else np.float32(np.log(np.float64(r.d))) / np.float32(np.log(2.0)) * np.float32(r.q)
        assert np.float32(r.x) == want


def test_odds_ratio(spark):
    cases = {"0": 0.0, "1": 1.0, "0.5": 2.0, "Inf": 0.0, "inf": 0.0, "-Inf": -math.inf, "2.5": 2.5, "-0.5": -0.5}
    df = spark.createDataFrame([(k,) for k in [*cases, "NaN"]], "s string").select("s", parse.odds_ratio(F.col("s")).alias("x"))
    got = {r.s: r.x for r in df.collect()}
    assert math.isnan(got.pop("NaN")) and got == cases


def test_pairs_and_defaults(spark):
    codes = list(parse.STRAND_BIAS)
    df = spark.createDataFrame([(f"{a};{b}",) for a in codes for b in codes], "s string").select("s", parse.show_pair_bias(parse.pair_bias(F.col("s"))).alias("x"))
    assert all(r.x == ":".join(parse.STRAND_BIAS[c] for c in r.s.split(";")) for r in df.collect())
    sv = spark.range(1).select(parse.show_sv_info(parse.sv_info(F.lit("1-2-3-4"))).alias("a"), parse.sv_info(F.lit("0")).alias("b")).first()
    assert sv.a == "1-2-3" and sv.b is None


def test_general_number_text(spark):
    values = [0.0, -0.0, 90.0, 0.7, 1000.125, 999999.5, 1234565.0, 0.0001, 0.00009999999, 1e-5, 1e20, -2.5, 123456.5, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", general(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == ["%g" % v for v in values]


def test_index(spark, tmp_path):
    assert var.index_path("a/b.fasta.gz") == "a/b.fasta.gz.fai"
    (tmp_path / "bad.fai").write_text("chr1\tx\t1\t2\t3\n")
    with pytest.raises(Exception, match=".*"):
        var.read_index(spark, str(tmp_path / "bad.fai"))
    with pytest.raises(Exception, match=".*"):
        var.read_index(spark, str(tmp_path / "none.fai"))


def test_command_line(spark, files, monkeypatch, capfdbinary):
    files(spark, row())
    want = (files.folder / "out.vcf").read_bytes()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO((row() + "\n").encode())))
    for extra in ([], ["-i", "-", "-o", "-"]):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO((row() + "\n").encode())))
        out = io.BytesIO()
        monkeypatch.setattr("sys.stdout", io.TextIOWrapper(out))
        assert main(["-r", str(files.folder / "ref.fa"), "-s", SAMPLE, *extra]) == 0
        assert out.getvalue() == want
    with pytest.raises(SystemExit):
        main(["-r", "x", "-s", "y", "-m", "Paired"])


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts(spark, files, many_parts):
    files(spark, *[row(start=i + 1) for i in range(700)])
    reference = str(files.folder / "ref.fa")
    whole = (files.folder / "out.vcf").read_text()
    for target in ("parts", "parts.gz"):
        assert convert(spark, str(files.folder / "in.var"), str(files.folder / target), reference, SAMPLE, parts=True) == 700
        found = sorted((files.folder / target).glob("part-*"))
        data = b"".join(p.read_bytes() for p in found)
        assert len(found) > 1 and (gzip.decompress(data) if target.endswith("gz") else data).decode() == whole
        with pytest.raises(FileExistsError):
            convert(spark, str(files.folder / "in.var"), str(files.folder / target), reference, SAMPLE, parts=True)
    # Every block carries its own size, and together they are the file.
    at = 0
    while at < len(data):
        assert data[at : at + 4] == b"\x1f\x8b\x08\x04" and data[at + 12 : at + 14] == b"BC"
        at += int.from_bytes(data[at + 16 : at + 18], "little") + 1
    assert at == len(data) and data.endswith(vcf.BGZF_END) and data.count(vcf.BGZF_END) == 1


def test_a_failed_job_leaves_no_parts(spark, files):
    (files.folder / "in.var").write_text("".join(x + "\n" for x in (row(), row(start=5, sample="other"))))
    for target in ("more", "more.gz"):
        with pytest.raises(ValueError, match="Expected sample"):
            convert(spark, str(files.folder / "in.var"), str(files.folder / target), str(files.folder / "ref.fa"), SAMPLE, parts=True)
    assert sorted(p.name for p in files.folder.iterdir()) == ["in.var", "ref.fa.fai"]


def test_other_failures_stay_what_they_are(spark, files):
    with pytest.raises(OSError, match="none"):
        files(spark, row(), target="none/out.vcf")


def test_progress(caplog):
    with caplog.at_level("INFO", "lociflow"):
        vcf.told(0, 99_999)
        vcf.told(99_999, 250_000)
        vcf.told(250_000, 299_999)
    assert [r.getMessage() for r in caplog.records] == [f"Processed {n} variant records" for n in (100_000, 200_000)]


def test_progress_is_told_while_a_job_runs(spark, monkeypatch, caplog, tmp_path):
    import time

    monkeypatch.setattr(vcf, "PROGRESS", 100)
    monkeypatch.setattr(vcf, "POLL", 0.05)
    done = spark.sparkContext.accumulator(0)

    def slow(batches):
        for pdf in batches:
            time.sleep(1 if pdf["id"].iloc[0] < 400 else 2)
            done.add(len(pdf))
            yield pdf

    with caplog.at_level("INFO", "lociflow"), vcf.Progress(lambda: done.value):
        spark.range(0, 800, 1, 8).mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
        ended = time.time()
    assert [r.getMessage() for r in caplog.records] == [f"Processed {n} variant records" for n in range(100, 801, 100)]
    assert caplog.records[0].created < ended - 1 and caplog.records[0].threadName == "progress"


@pytest.mark.parametrize("target", ["out.vcf", "parts", "parts.gz"])
def test_conversions_tell_their_progress(spark, files, monkeypatch, caplog, target):
    monkeypatch.setattr(vcf, "PROGRESS", 100)
    (files.folder / "in.var").write_text("".join(row(start=i + 1) + "\n" for i in range(350)))
    with caplog.at_level("INFO", "lociflow"):
        convert(spark, str(files.folder / "in.var"), str(files.folder / target), str(files.folder / "ref.fa"), SAMPLE, parts=target != "out.vcf")
    assert [r.getMessage() for r in caplog.records] == [f"Processed {n} variant records" for n in (100, 200, 300, 350)]


def test_cells_of_quoted_and_wide_lines(spark):
    cases = {"a\tb": ["a", "b"], "\ta\t": ["", "a", ""], 'x\t"q""r\ts"\t': ["x", 'q"r\ts', ""], '"a"b\tc"d': ["ab", 'c"d'], '""\t"': ["", ""], 'x\t"y""z': ["x", 'y"z'], "\t".join(["v"] * 100 + ['"w"']): ["v"] * 100 + ["w"], '"' + "x" * 100_000 + '"': ["x" * 100_000]}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, value string").select("i", var.cells(F.col("value")).alias("c"))
    assert [r.c for r in df.orderBy("i").collect()] == list(cases.values())


def test_general_text_of_floats(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = [float(np.float32(x)) for x in [*rng.random(300), *(rng.random(300) * 1e6), *10.0 ** rng.uniform(-9, 12, 300), *np.arange(0, 40, 0.25), 0.001, 0.0001, 1e7, 123456.0, 1234567.0, 99999.95]]
    df = spark.createDataFrame([(v,) for v in values], "x float").select(general(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == ["%g" % v for v in values]


def test_general_text_of_halves_and_near_halves(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    half = (rng.integers(100_000, 1_000_000, 2000) + 0.5) / 10.0 ** rng.integers(-14, 12, 2000)
    powers = 10.0 ** np.arange(-30, 30)
    values = [float(v) for v in [*half, *np.nextafter(half, 0), *powers, *np.nextafter(powers, 0), *np.nextafter(powers, np.inf), *rng.integers(0, 1 << 32, 2000, dtype=np.uint32).view(np.float32)]]
    values += [-v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", general(F.col("x")).alias("t"))
    for r in df.collect():
        assert r.t == "%g" % abs(values[r.i]) if values[r.i] != values[r.i] else r.t == "%g" % values[r.i]


@pytest.mark.parametrize("end", ['"', ""])
def test_a_million_quotes_need_no_stack(spark, end):
    line = "a\t" + '"' + '""' * 1_000_000 + end + ("\tb" if end else "")
    df = spark.createDataFrame([(line,)], "value string").select(var.cells(F.col("value")).alias("c"), F.col("value").rlike(var.ENDS_OPEN).alias("open"), F.col("value").rlike(var.STAYS_OPEN).alias("stays"))
    r = df.first()
    assert r.c == ["a", '"' * 1_000_000, *(["b"] if end else [])] and r.open == (not end)


def test_line_breaks_in_quotes_over_blocks_of_files(spark, tmp_path):
    import csv
    import random

    sizes = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    rng, want = random.Random(4), []
    for name in ("a", "b", "c"):
        text = ""
        for _ in range(150):
            fields = ["".join(rng.choice(["\n", "\r\n", '"', "\t", "x", "é"]) for _ in range(rng.randrange(14))) if rng.random() < 0.5 else f"v{rng.randrange(99)}" for _ in range(4)]
            text += "\t".join('"' + f.replace('"', '""') + '"' if set(f) & set('"\t\r\n') or rng.random() < 0.2 else f for f in fields) + rng.choice(["\n", "\r\n", "\n\n"])
        text += '"' + "open\n" * 30 if name == "c" else ""  # what nothing closes goes to the end
        (tmp_path / name).write_bytes(text.encode())
        want += [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if r]
    want[-1] = ["open\n" * 30]
    want[-1][0] = want[-1][0][:-1]
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        df = var.read_calls(spark, str(tmp_path), line_breaks=True)
        assert df.select("ord.file", "ord.block").distinct().count() > 20
        assert [r.cells for r in df.orderBy("ord").collect()] == want and df.where("fault is not null").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_breaks_in_quotes_shuffle_only_rows_over_the_end_of_a_block(spark, tmp_path):
    # Lines as long as these go to one Arrow batch of thousands; rows go on over the ends of batches too.
    text = "".join(f'{i}\t"a\n""\n{i}"\tb"c\n{i}\tx\ty\n' for i in range(40_000))
    (tmp_path / "a").write_text(text)

    def shuffled():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before = shuffled()
    rows = sorted(var.read_calls(spark, str(tmp_path), line_breaks=True).collect(), key=lambda r: r.ord)
    assert [r.cells for r in rows] == [x for i in range(40_000) for x in ([f"{i}", f'a\n"\n{i}', 'b"c'], [f"{i}", "x", "y"])]
    assert sum(n for k, n in shuffled().items() if k not in before) < len(text) // 50


def test_conversion_over_line_breaks(spark, files):
    text, body = files(spark, row(), row(start=5).replace("gene", '"ge\n\nne"'), row(start=6))
    assert [b[1] for b in body] == ["100", "5", "6"]
    with pytest.raises(ValueError, match="depth"):
        files(spark, row(start=5).replace("gene", '"ge\nne"'), row(depth="x"))


def test_what_a_reader_cannot_take_fails_in_any_row(spark, tmp_path):
    (tmp_path / "ref.fa.fai").write_text("chr1\t1000\t5\t60\t61\n")
    good = row().encode() + b"\n"
    for bad, message in ((row(start=2).encode().replace(b"gene", b"g\xffe"), "not valid UTF-8"), (row(ref="").encode().replace(b"gene", b"g\xffe"), "not valid UTF-8"), (row(ref="", width=30).encode(), "expected 38 fields, found 30")):
        (tmp_path / "in.var").write_bytes(good + bad + b"\n" + row(start=9, depth="x").encode())
        with pytest.raises(ValueError, match=message):
            convert(spark, str(tmp_path / "in.var"), str(tmp_path / "out.vcf"), str(tmp_path / "ref.fa"), SAMPLE)


def test_width_is_that_of_the_first_file(spark, tmp_path):
    (tmp_path / "a").write_text("")
    (tmp_path / "b c").write_text("\n" + row(width=36) + "\n")
    (tmp_path / "d").write_text((row() + "\n") * 50)
    assert var.first_width(spark, str(tmp_path)) == 36


def test_rows_pass_at_sight_or_are_looked_at(spark):
    import itertools

    odd = {"depth": ["2147483647", "2147483648", "0000000000012", "+5", "-5", "", "5\n", "٣"], "start": ["9223372036854775807", "9223372036854775808", "-1", "+1"], "af": ["1e5", ".5", "5.", "1.e3", "inf", "-Infinity", "NaN", "1f", "0x1p3", " 1", "."], "odds": ["INF", "x"], "bias": ["0;2", "0;3", "0;", "02;", "0,2"], "rate": ["0", "00", ""], "sv": ["0", "1-2-3-x", "99999999999-1-1", "+1-2-3", "1-2"], "kind": ["a\tb"]}
    rows = [row(**{k: v}).split("\t") if k != "kind" else [*row().split("\t")[:35], v, *row().split("\t")[36:]] for k, vs in odd.items() for v in vs]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>")
    strict = [f.alias(f"s{i}") for i, f in enumerate(parse.DECODERS[k](F.get("cells", F.lit(i))) for i, (_, k) in enumerate(schema.FIELDS))]
    found = df.select("i", parse.problem(F.col("cells")).alias("problem"), F.struct(*parse.decoded(F.col("cells"))).cast("string").alias("fast"), F.struct(*strict).cast("string").alias("strict"), *strict).collect()
    for r in found:
        bad = [i for i, (_, k) in enumerate(schema.FIELDS) if r[f"s{i}"] is None and i < len(rows[r.i]) and not (k in ("rate", "sv") and rows[r.i][i] == "0")]
        assert (r.problem or "").startswith(f"could not decode field {bad[0]} (" if bad else ""), rows[r.i]
        assert bool(r.problem) == bool(bad) and (bad or r.fast == r.strict)
    assert len(list(itertools.filterfalse(lambda r: r.problem, found))) > 12


def test_no_field_is_decoded_twice(spark, tmp_path):
    (tmp_path / "in.var").write_text(row() + "\n")
    rows = var.read_calls(spark, str(tmp_path / "in.var"))
    for out in (calls.convert(rows, SAMPLE, ["chr1"], True, 38), calls.convert_noting(rows, SAMPLE, ["chr1"], True, 38)[0]):
        plan = out.select(calls.line())._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1 and plan.count("try_cast(cells") == len([n for n, k in schema.FIELDS if n in calls.NEEDED and k != "text"])


def test_defaults(spark):
    r = spark.range(1).select(parse.show_pair_bias(parse.default_pair()).alias("pair"), parse.show_sv_info(parse.default_sv()).alias("sv")).first()
    assert (r.pair, r.sv) == ("UnDetected:UnDetected", "0-0-0")
    assert vcf.GZIP_EXTENSION == "gz"


@pytest.mark.parametrize("name", ["one.vcf", "one.vcf.gz"])
def test_one_file_by_the_executors(spark, tmp_path, name):
    """The same bytes as the driver's own file has (unpacked, where compressed), whole or not at all, over an older one."""
    (tmp_path / "ref.fa.fai").write_text("chr1\t90000\t5\t60\t61\n")
    (tmp_path / "in.var").write_text("".join(row(start=i) + "\n" for i in random_order(5000)))
    args = (str(tmp_path / "ref.fa"), SAMPLE)
    convert(spark, str(tmp_path / "in.var"), str(tmp_path / "plain.vcf"), *args)
    want = (tmp_path / "plain.vcf").read_bytes()
    target = tmp_path / name
    target.write_text("older")
    assert convert(spark, str(tmp_path / "in.var"), f"file://{target}", *args) == 5000
    data = target.read_bytes()
    assert (gzip.decompress(data) if name.endswith("gz") else data) == want
    assert data.endswith(vcf.BGZF_END) or name == "one.vcf"
    (tmp_path / "in.var").write_text(row(depth="x") + "\n")
    with pytest.raises(ValueError, match="depth"):
        convert(spark, str(tmp_path / "in.var"), f"file:{target}", *args)
    (tmp_path / "in.var").write_text("")
    assert target.read_bytes() == data and not [x for x in os.listdir(tmp_path) if x.startswith(f"{name}.")]
    assert convert(spark, str(tmp_path / "in.var"), f"file:{target}", *args) == 0
    assert (gzip.decompress(target.read_bytes()) if name.endswith("gz") else target.read_bytes()).count(b"\n") == want.count(b"\n") - 5000


def random_order(n):
    import random

    return random.Random(1).sample(range(1, n + 1), n)


def test_common_numbers_need_no_long_way(spark):
    import random

    from lociflow.functions import text

    rng = random.Random(8)
    some = [rng.uniform(1, 10.0 ** rng.randrange(1, 7)) for _ in range(3000)] + [round(rng.uniform(1, 9e5), 2) for _ in range(500)]
    edges = [1.0, 9.999994, 9.999996, 99.99996, 99999.96, 999998.4, 999998.6, 123456.0, 100000.0, 33.21928]
    beyond = [0.999999, 999999.0, 999999.6, 1e6, 1.000005, 123456.5, -2.25, float("nan"), float("inf"), 0.0]
    rows = spark.createDataFrame([(x,) for x in some + edges + beyond], "x double").select("x", text.general(F.col("x")).alias("g"), text._common(F.col("x")).alias("c")).collect()
    assert all(r.g == f"{r.x:g}" for r in rows) and all(r.c in (None, r.g) for r in rows)
    assert sum(r.c is None for r in rows[: len(some)]) < len(some) // 100 and all(r.c for r in rows[len(some) : len(some) + len(edges)])
    assert [r.c for r in rows[-len(beyond) :]] == [None] * len(beyond)


def test_a_conversion_sorts_keys_by_their_hash_and_makes_lines_after_the_last_sort(spark):
    from lociflow.sources import vcf

    made = spark.createDataFrame([(1, row().split("\t"))], "ord int, cells array<string>")
    records = calls.convert(made, SAMPLE, ["chr1"])
    plan = vcf.lines(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("END=") < plan.index("Exchange rangepartitioning(ord")
    assert "Sort [_groupingexpression" in plan and [r.value.split("\t")[1] for r in vcf.lines(records).collect()] == ["100"]


def test_order_carries_numbers_of_files_in_the_order_of_their_paths(spark, tmp_path):
    for name in ("b c", "a%20b", "ü#1", "d"):
        (tmp_path / name).write_text(name + "\n\n" + name + " again\n")
    with gzip.open(tmp_path / "e.gz", "wt") as out:
        out.write("packed\n")
    rows = var.read_calls(spark, str(tmp_path))
    assert rows.schema["ord"].dataType.simpleString() == "struct<file:int,block:bigint,line:bigint>"
    names = ["a%20b", "b c", "d"]
    found = [(r.ord.file, r.cells[0]) for r in rows.orderBy("ord").collect()]
    assert found == [(i, x) for i, n in enumerate(names) for x in (n, f"{n} again")] + [(3, "packed"), (4, "ü#1"), (4, "ü#1 again")]
    assert [r.ord.file for r in var.read_calls(spark, str(tmp_path / "d")).collect()] == [0, 0]
    (tmp_path / "none").mkdir()
    assert var.read_calls(spark, str(tmp_path / "none")).count() == 0


def test_a_conversion_shuffles_an_order_once_and_no_row_for_a_list_of_contigs(spark):
    made = spark.createDataFrame([(1, row().split("\t"))], "ord int, cells array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = calls.convert(made, SAMPLE, ["chr1"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "min_by(" not in plan and "partial_min(" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_compressed_parts_are_unpacked_by_readers(spark, files, many_parts):
    files(spark, *[row(start=i + 1) for i in range(700)])
    whole = (files.folder / "out.vcf").read_text()
    convert(spark, str(files.folder / "in.var"), str(files.folder / "parts.gz"), str(files.folder / "ref.fa"), SAMPLE, parts=True)
    found = sorted((files.folder / "parts.gz").glob("part-*"))
    assert "".join(gzip.decompress(p.read_bytes()).decode() for p in found) == whole
    assert sorted(r.value for r in vcf.read_lines(spark, str(files.folder / "parts.gz")).collect()) == sorted(whole.splitlines())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_file_query_keeps_its_files_packed(spark, tmp_path, monkeypatch):
    from lociflow.plans import catalog

    monkeypatch.setattr(catalog, "scratch", lambda spark: f"file://{tmp_path}")
    lines = catalog.QUERIES["convert_file"](spark, "/root/testdata/sf0.001").count()
    size = lambda folder: sum(p.stat().st_size for p in (tmp_path / folder).glob("part-*"))
    read = lambda folder: sum(len(gzip.decompress(p.read_bytes())) for p in (tmp_path / folder).glob("part-*"))
    folders = sorted(x.name for x in tmp_path.iterdir() if x.name != "ref.fa.fai")
    assert folders == ["calls", "vcf.gz"] and lines > 4000
    assert all(size(f) < 0.4 * read(f) for f in folders)
