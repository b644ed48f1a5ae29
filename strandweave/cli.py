"""``python -m strandweave.cli reads.fastq.gz -o corrected.fastq``: corrects a file of reads."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from strandweave.plans.pipeline import Options, correct
from strandweave.sources import files, readers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("reads")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-k", type=int)
    p.add_argument("--h-min", type=int)
    p.add_argument("--h-max", type=int)
    p.add_argument("--e-min", type=float, default=0.05)
    p.add_argument("--e-max", type=float, default=0.15)
    p.add_argument("--h-rate", type=float, default=0.0)
    p.add_argument("--subset", type=float, default=1.0)
    p.add_argument("--em-iterations", type=int, default=10)
    p.add_argument("--em-threshold", type=float, default=1e-10)
    p.add_argument("--index", help="a stored index of these reads; needs -k")
    p.add_argument("--degree", type=int, help="keep only so many of the best overlaps of a read")
    p.add_argument("--no-cluster", action="store_true")
    p.add_argument("--recluster", action="store_true", help="cluster anew in each EM step")
    a = p.parse_args(argv)
    if a.index and not a.k:
        p.error("--index needs the -k that it was made with")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("strandweave").getOrCreate()
    files.check_output(spark, a.output)
    options = Options(a.k, a.h_min, a.h_max, a.e_min, a.e_max, a.h_rate, a.subset, a.em_iterations, a.em_threshold, not a.no_cluster, a.recluster, a.index, a.degree)
    logging.info("correcting %s", a.reads)
    files.write_corrected(correct(readers.scan_reads(spark, a.reads), options), a.output)
    logging.info("written %s", a.output)


if __name__ == "__main__":
    main()
