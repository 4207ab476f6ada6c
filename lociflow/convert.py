"""The conversion from files to files, and its command line."""

from __future__ import annotations

import argparse
import logging
import os
import re
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from lociflow.operators import calls
from lociflow.sources import var, vcf
from lociflow.sources.shared import upload

MODES = ("TumorOnly",)
SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:/")
log = logging.getLogger("lociflow")


def convert(spark: SparkSession, source: str, target: str | None, reference: str, sample: str, mode: str = "TumorOnly", skip_non_variants: bool = False, parts: bool = False) -> int:
    """Convert a file of calls, or a folder of them. Returns the number of records.

    With ``parts`` executors write a folder of part files to any file system; a path that ends in .gz gives block-gzipped ones.
    Without, the records meet in one file: a target with a scheme (hdfs:, s3a:, file:) is written by the executors, a plain path is
    a local file of the driver; ``target`` None or ``-`` is standard output. The rows are read and
    decoded once: what is wrong with them is noted in the same pass, and nothing is published if there is something.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode: {mode}")
    contigs = var.read_index(spark, var.index_path(reference))
    head = vcf.header(sample, contigs, reference)
    sink = vcf.to_stdout if target in (None, "-") else vcf.to_parts if parts else vcf.to_one if SCHEME.match(target) else vcf.to_file

    def attempt(line_breaks: bool) -> int:
        rows = var.read_calls(spark, source, line_breaks)
        width = var.first_width(spark, source, line_breaks)
        records, found = calls.convert_noting(rows, sample, [c for c, _ in contigs], skip_non_variants, width)

        def verify() -> None:
            if message := found.problem():
                raise BadRow(message)

        return sink(records, target, head, verify)

    try:
        n = attempt(False)
    except BadRow as error:
        if str(error) != var.UNCLOSED:
            raise
        # A quoted field goes on over line ends: rows have to be put together first, which other input is spared.
        n = attempt(True)
    log.info("Processed %d variant records", n)
    return n


class BadRow(ValueError):
    """The first bad row of the input, in its order."""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lociflow", description="Convert tumor-only variant calls to VCF.")
    parser.add_argument("-r", "--reference", required=True, help="indexed FASTA reference; only its index is read")
    parser.add_argument("-s", "--sample", required=True, help="sample that all rows must name")
    parser.add_argument("-i", "--input", help="file of calls; standard input by default or for -")
    parser.add_argument("-o", "--output", help="VCF file; standard output by default or for -")
    parser.add_argument("-m", "--mode", choices=MODES, default="TumorOnly")
    parser.add_argument("--parts", action="store_true", help="write a folder of part files, by the executors, instead of one file")
    parser.add_argument("--skip-non-variants", action="store_true", help="leave out rows whose alleles are equal")
    args = parser.parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("LOCIFLOW_LOG", "INFO").upper(), format="[%(asctime)s %(levelname)s %(name)s] %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("lociflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    source, spool = args.input, None
    try:
        if source in (None, "-"):
            log.info("Input stream: STDIN")
            spool = tempfile.NamedTemporaryFile(suffix=".var", delete=False)
            with spool:
                shutil.copyfileobj(sys.stdin.buffer, spool)
            source = upload(spark, spool.name)
        else:
            log.info("Input file: %s", source)
        log.info("Output stream: STDOUT" if args.output in (None, "-") else "Output file: %s", *([] if args.output in (None, "-") else [args.output]))
        convert(spark, source, args.output, args.reference, args.sample, args.mode, args.skip_non_variants, args.parts)
    finally:
        if spool:
            os.unlink(spool.name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
