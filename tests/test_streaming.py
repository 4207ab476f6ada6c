"""The stream gives the batch conversion's records, whatever the split into files."""

import pytest
from test_calls import SAMPLE, row

from lociflow.operators import calls
from lociflow.sources import var
from lociflow.streaming.calls import read_stream, start


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.var").write_text("".join(row(start=i % 5 + 1, depth=i) + "\n" for i in range(20)))
    start(read_stream(spark, str(source), 1), out, SAMPLE, ["chr1", "chr2"]).awaitTermination()
    # Keys seen before stay closed when further files arrive, even for rows of another sample.
    (source / "b.var").write_text(row(start=1, depth=99, sample="other") + "\n" + row("chr2", 3, depth=42) + "\n")
    start(read_stream(spark, str(source), 1), out, SAMPLE, ["chr1", "chr2"]).awaitTermination()
    got = [r.value for r in spark.read.text(f"{out}/records").collect()]
    batch = calls.convert(var.read_calls(spark, str(source)), SAMPLE, ["chr1", "chr2"])
    assert sorted(got) == sorted(r.value for r in batch.select(calls.line().alias("value")).collect())
    assert len(got) == 6


def test_bad_row_fails_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.var").write_text(row(sample="other") + "\n")
    with pytest.raises(Exception, match="Expected sample"):
        start(read_stream(spark, str(source)), str(tmp_path / "out"), SAMPLE, ["chr1"]).awaitTermination()


def test_rows_of_another_width_fail_the_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.var").write_text(row() + "\n")
    start(read_stream(spark, str(source)), out, SAMPLE, ["chr1"]).awaitTermination()
    (source / "b.var").write_text(row(start=5, width=37) + "\n")
    with pytest.raises(Exception, match="expected 39 fields, found 37|expected 38 fields, found 37"):
        start(read_stream(spark, str(source)), out, SAMPLE, ["chr1"]).awaitTermination()


def test_a_stream_goes_on(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.var").write_text(row() + "\n")
    query = start(read_stream(spark, str(source)), out, SAMPLE, ["chr1"], every="0 seconds")
    try:
        query.processAllAvailable()
        (source / "b.var").write_text(row(start=5) + "\n" + row() + "\n")
        query.processAllAvailable()
        assert query.isActive and spark.read.text(f"{out}/records").count() == 2
    finally:
        query.stop()


def test_a_batch_reads_its_own_keys_alone(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    looked = []
    for n, starts in enumerate([range(1, 3001), range(2991, 3011), range(3011, 6011), range(6001, 6021)]):
        (source / f"{9 - n}.var").write_text("".join(row(start=i) + "\n" for i in starts))
        query = start(read_stream(spark, str(source)), out, SAMPLE, ["chr1", "chr2"])
        query.awaitTermination()
        looked.append(query.lastProgress["stateOperators"][0]["customMetrics"])
    gets = [m["rocksdbGetCount"] for m in looked]
    read = [m["rocksdbTotalBytesRead"] for m in looked]
    assert gets[1] == gets[3] and gets[1] < 100 < 3000 <= gets[0] == gets[2]
    assert read[3] <= 1.5 * read[1] < 20_000  # ten known keys each, behind 3000 and behind 6000
    assert spark.read.text(f"{out}/records").count() == 6020


def test_first_wins_by_arrival_whatever_a_file_is_called(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "z.var").write_text("\n".join([row(start=1, depth=7), row(start=2, ref="", depth=1), row(start=1, depth=8)]) + "\n")
    start(read_stream(spark, str(source)), out, SAMPLE, ["chr1"]).awaitTermination()
    (source / "a.var").write_text("\n".join([row(start=1, depth=9), row(start=2, depth=5), row(start=2, depth=6)]) + "\n")
    start(read_stream(spark, str(source)), out, SAMPLE, ["chr1"]).awaitTermination()
    got = sorted(r.value.split(":")[-2] for r in spark.read.text(f"{out}/records").collect())
    assert got == ["5", "7"]


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.var").write_text(row(start=1) + "\n")
    start(read_stream(spark, str(source)), str(out), SAMPLE, ["chr1"]).awaitTermination()
    (source / "b.var").write_text(row(start=1, depth=3) + "\n" + row(start=2, depth=4) + "\n")
    start(read_stream(spark, str(source)), str(out), SAMPLE, ["chr1"]).awaitTermination()
    before = sorted(r.value for r in spark.read.text(f"{out}/records").collect())
    for name in ("1", ".1.crc"):
        (out / "checkpoint" / "commits" / name).unlink()
    start(read_stream(spark, str(source)), str(out), SAMPLE, ["chr1"]).awaitTermination()
    assert sorted(r.value for r in spark.read.text(f"{out}/records").collect()) == before and len(before) == 2
