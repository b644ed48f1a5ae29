import gzip

import pytest

from pyspark.sql import functions as F

from strandweave import cli, scratch
from strandweave.operators import kmers
from strandweave.operators.ranking import first_per_key, with_ordinal
from strandweave.operators.reads import both_strands
from strandweave.sources import files, readers


def test_fastq_in_small_splits(spark, tmp_path):
    lines = "".join(f"@r{i}\nacgt{'A' * (i % 7)}\n+\n@{'#' * 9}\n" for i in range(500)) + "@cut\nACG\n"
    (tmp_path / "a.fastq").write_text(lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = readers.scan_fastq(spark, str(tmp_path / "a.fastq")).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.name for r in rows] == [f"r{i}" for i in range(500)]
    assert rows[8].seq == "ACGTA"


def test_gzip_and_plain(spark, tmp_path):
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write("@x\nacgt\n+\n!!!!\n")
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write(" acgt \n\nGGN\n")
    (tmp_path / "a.txt").write_text("acgt\nTT\n")
    assert [tuple(r) for r in readers.scan_reads(spark, str(tmp_path / "a.fastq.gz")).collect()] == [(0, "ACGT")]
    assert sorted(tuple(r) for r in readers.scan_reads(spark, str(tmp_path / "a.txt.gz")).collect()) == [(0, "ACGT"), (2, "GGN")]
    assert [r.seq for r in readers.scan_text(spark, str(tmp_path / "a.txt")).collect()] == ["ACGT", "TT"]


@pytest.mark.parametrize("size", ["60", "134217728"])
def test_rows_of_several_files(spark, tmp_path, size):
    """Row numbers go on from file to file, in splits or whole, and cut records cost no number twice."""
    (tmp_path / "a.txt").write_text("ACG\n\nTTA\n")
    (tmp_path / "b.txt").write_text("".join(f"{'ACGT'[i % 4]}C\n" for i in range(40)))
    (tmp_path / "c.fastq").write_text("@x\nAA\n+\n!!\n@cut\n")
    (tmp_path / "d.fastq").write_text("".join(f"@d{i}\nAC{'G' * i}\n+\n@@\n" for i in range(30)) + "@cut\nA\n")
    (tmp_path / "e.fastq").write_text("@e\nGG\n+\n!!\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        text = sorted(tuple(r) for r in readers.scan_reads(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]).collect())
        fastq = sorted(tuple(r) for r in readers.scan_reads(spark, [str(tmp_path / f"{c}.fastq") for c in "cde"]).collect())
        records = {(r.file[-7:], r.record): r.name for r in readers.scan_fastq(spark, [str(tmp_path / "d.fastq")]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert text == [(0, "ACG"), (2, "TTA")] + [(3 + i, "ACGT"[i % 4] + "C") for i in range(40)]
    assert [s for _, s in fastq] == ["AA"] + ["AC" + "G" * i for i in range(30)] + ["GG"]
    assert len({r for r, _ in fastq}) == 32
    assert records == {("d.fastq", i): f"d{i}" for i in range(30)}


def test_no_join_of_splits_with_splits(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r\nA\n+\n!\n")
    plan = readers.scan_fastq(spark, str(tmp_path / "a.fastq"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_files_follow_the_rows(spark, tmp_path):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i, i % 5) for i in range(3000)], "kmer string, read_id long, pos int")
    files.write_index(df, str(tmp_path / "index"), buckets=4, file_rows=500)
    assert sorted(map(tuple, files.read_index(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, df.collect()))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "index")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 1200


def test_shared_folder_is_needed_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = dict

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)


def test_malformed_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("r\nA\n+\n!\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        readers.scan_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_output_paths(spark, tmp_path):
    files.check_output(spark, str(tmp_path / "new" / "out.fastq"))
    (tmp_path / "new" / "out.fastq.seq").mkdir()
    with pytest.raises(FileExistsError):
        files.check_output(spark, str(tmp_path / "new" / "out.fastq"))


def test_ordinals_and_ranks(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "x long, k long")
    assert sorted((r.x, r.ordinal) for r in with_ordinal(df, ["x"]).collect()) == [(i, i) for i in range(101)]
    got = first_per_key(df, ["k"], ["x"], 4).collect()
    for k in range(3):
        assert sorted(r.x for r in got if r.k == k) == sorted(x * 7 % 101 for x in range(101) if x % 3 == k)[:4]


def test_command_line(spark, tmp_path):
    strand = "ACGTTGCAAGCTTAGCCATGATCGGATTACAGCTTACGGATCCGTAAC"
    (tmp_path / "r.txt").write_text("\n".join(strand[i : i + 30] for i in range(18)) + "\n")
    cli.main([str(tmp_path / "r.txt"), "-o", str(tmp_path / "out.fastq"), "--subset", "1", "-k", "8", "--no-cluster"])
    text = [r.value for r in spark.read.text(str(tmp_path / "out.fastq.seq")).collect()]
    assert sorted(text) == sorted(strand[i : i + 30] for i in range(18))
    assert len(readers.scan_fastq(spark, str(tmp_path / "out.fastq")).collect()) == 18
    reads = both_strands(readers.scan_reads(spark, str(tmp_path / "r.txt")))
    files.write_index(kmers.dedupe(kmers.explode_kmers(reads, 8)), str(tmp_path / "index"))
    cli.main([str(tmp_path / "r.txt"), "-o", str(tmp_path / "again.fastq"), "-k", "8", "--index", str(tmp_path / "index"), "--no-cluster"])
    assert [r.value for r in spark.read.text(str(tmp_path / "again.fastq")).collect()] == [r.value for r in spark.read.text(str(tmp_path / "out.fastq")).collect()]
    with pytest.raises(SystemExit):
        cli.main(["r.txt", "-o", "x", "--index", "i"])
