"""Reading files of reads: plain text and FASTQ, compressed or not, chosen by extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(seq)``: one read a line, without surrounding space, in upper case; blank lines are no reads."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("seq")).where("seq <> ''")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line, row, value)``: lines numbered from 0 within each file, however it is split, and ``row``, numbered
    on over all files in the order of their names.

    Lines are counted per split; a line's number is its place in its split after those of the splits before,
    running sums over a table with one row a split.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("i"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", upto(Window.orderBy("file")).alias("before_file"))
    offsets = splits.select("file", "block", "first", upto(Window.partitionBy("file").orderBy("block")).alias("before")).join(files, "file")
    line = F.col("before") + F.col("i") - F.col("first")
    return lines.join(offsets, ["file", "block"]).select("file", "block", line.alias("line"), (F.col("before_file") + line).alias("row"), "value")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines in order, the records of four that a split holds whole as one row with ``whole``; other lines as they are."""
    for b in batches:
        if not b.num_rows:
            continue
        row, line, value = b.column("row").to_numpy(), b.column("line").to_numpy(), b.column("value").cast(pa.large_string())
        file = b.column("file").cast(pa.large_string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = len(line)
        head = np.flatnonzero(line % 4 == 0)
        head = head[head + 3 < n]
        head = head[(line[head + 3] == line[head] + 3) & (row[head + 3] == row[head] + 3) & (file[head + 3] == file[head])]
        rest = np.ones(n, bool)
        for k in range(4):
            rest[head + k] = False
        rest = np.flatnonzero(rest)
        at = np.concatenate([head, rest])
        whole = np.arange(len(at)) < len(head)
        none = np.zeros(len(rest), np.int64)
        more = [pa.array(np.concatenate([head + k, none])) for k in range(4)]
        lines = [value.take(pa.array(np.concatenate([head, rest]))), *(pc.if_else(pa.array(whole), value.take(m), None) for m in more[1:])]
        i = pa.array(at)
        yield pa.RecordBatch.from_arrays([b.column("file").take(i), pa.array(line[at]), pa.array(row[at]), pa.array(whole), *(x.cast(pa.string()) for x in lines)], names=["file", "line", "row", "whole", "l0", "l1", "l2", "l3"])


def scan_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, record, row, name, seq, qual)``: records of four lines, sequences in upper case; ``record`` counts within a
    file, ``row`` over all.

    A record that does not begin with ``@`` or whose third line does not begin with ``+`` is an error; an
    incomplete record at the end of a file is dropped.  Only records that a split or a batch cuts are shuffled.
    """
    lines = numbered_lines(spark, path).sortWithinPartitions("file", "block", "line")  # in order, whichever way the join went
    kept = lines.mapInArrow(_records, "file string, line long, row long, whole boolean, l0 string, l1 string, l2 string, l3 string")
    record = F.floor(F.col("line") / 4)
    names = ("name", "seq", "plus", "qual")
    whole = kept.where("whole").select("file", record.alias("record"), *[F.col(f"l{k}").alias(c) for k, c in enumerate(names)], (F.col("row") - F.col("line")).alias("base"))
    cut = kept.where("not whole").groupBy("file", record.alias("record")).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("line") % 4 == k, F.col("l0"))).alias(c) for k, c in enumerate(names)], F.first(F.col("row") - F.col("line")).alias("base"))
    rows = whole.unionByName(cut.where("n = 4").drop("n"))
    ok = F.startswith("name", F.lit("@")) & F.startswith("plus", F.lit("+"))
    name = F.when(ok, F.substring(F.col("name"), F.lit(2), F.length("name"))).otherwise(F.raise_error(F.concat(F.lit("no FASTQ record: "), F.col("name"))))
    # lines before a file are four a record, unless a file before it ends within one
    return rows.select("file", "record", F.ceil(F.col("base") / 4).alias("before"), name.alias("name"), F.upper(F.trim("seq")).alias("seq"), "qual").withColumn("row", F.col("before") + F.col("record")).drop("before")


def scan_reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(src_row, seq)`` of files by their extension: ``.fastq`` and ``.fq`` are FASTQ, all else one read a
    line; a further ``.gz`` is decompressed (such a file is one split, so its rows are spread afterwards).

    ``src_row`` differs between all reads, of whichever file, and follows the order of the files' names.
    """
    first = (path if isinstance(path, str) else path[0]).lower()
    plain = first.removesuffix(".gz")
    if plain.endswith((".fastq", ".fq")):
        return scan_fastq(spark, path).select(F.col("row").alias("src_row"), "seq")
    rows = numbered_lines(spark, path).select(F.col("row").alias("src_row"), F.upper(F.trim("value")).alias("seq")).where("seq <> ''")
    return rows.repartition(spark.sparkContext.defaultParallelism) if plain != first else rows
