"""Files read in byte ranges give the rows that reading them whole gives, wherever they are cut."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.sources import ranges, reader

COLUMNS = ["aln_id", "row_idx", "id", "description", "residues", "quality", "hidden", "format"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture()
def cut(spark):
    """Sets the size of ranges."""

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield to
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def fasta(rng, n):
    out = ["; a comment", ""] if n % 2 else []
    for i in range(n):
        out.append(f">r{i} {'some words' if i % 3 else ''}")
        size = 900 if i == 4 else rng.randrange(0, 90)
        seq = "".join(rng.choice("ACGTacgt.~-") for _ in range(size))
        out += [seq[k : k + 30] for k in range(0, len(seq), 30)] + ([""] if i % 5 == 0 else [])
    return "\n".join(out) + "\n"


def fastq(rng, n, base):
    out = []
    for i in range(n):
        size = rng.randrange(0, 40) if i != 3 else 400
        out += [f"@r{i} d", "".join(rng.choice("ACGT") for _ in range(size)), "+" + ("r" if i % 2 else ""), "".join(rng.choice(base) for _ in range(size))]
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("size", [64, 1000])
def test_fasta(spark, tmp_path, cut, size):
    rng = random.Random(size)
    for k in range(3):
        (tmp_path / f"f{k}.fa").write_bytes((b"\xef\xbb\xbf" if k == 1 else b"") + fasta(rng, 7 + k).encode().replace(b"\n", b"\r\n" if k == 2 else b"\n"))
    want = rows(reader.read_sequences(spark, str(tmp_path), "fasta"))
    cut(size)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (5 if size < 200 else 0)
    assert rows(ranges.read_fasta(spark, str(tmp_path))) == want and len(want) == 24


@pytest.mark.parametrize("size", [64, 149])
def test_fastq(spark, tmp_path, cut, size):
    """Lines of scores that begin with '@' and '+', offsets of 33 and 64, records longer than a range."""
    rng = random.Random(size)
    for k, base in enumerate(["!#@+IJ", "@+AB", "@hfc;", "@"]):
        (tmp_path / f"f{k}.fq").write_text(fastq(rng, 9 + k, base) + "\n" * k)
    want = rows(reader.read_sequences(spark, str(tmp_path), "fastq"))
    cut(size)
    assert rows(ranges.read_fastq(spark, str(tmp_path))) == want and len(want) == 42
    assert all(len(r[4]) == len(r[5]) for r in want)


def test_failures(spark, tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>x\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        ranges.read_fasta(spark, str(tmp_path / "a.fa")).collect()
    (tmp_path / "b.fq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="four lines"):
        ranges.read_fastq(spark, str(tmp_path / "b.fq")).collect()
    (tmp_path / "c.fa").write_text("")
    assert ranges.read_fasta(spark, str(tmp_path / "c.fa")).select(F.count("*")).first()[0] == 0


def test_small_ranges_share_tasks(spark, tmp_path, cut):
    """Tasks follow the bytes, and no row is dealt by its file alone."""
    (tmp_path / "a.fq").write_text(fastq(random.Random(1), 400, "@hfc;"))
    cut(64)
    n = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    assert n > 200 and ranges._lines(spark, str(tmp_path)).rdd.getNumPartitions() <= max(4 * cores, n // ranges.TASK_RANGES)
    got = ranges.read_fastq(spark, str(tmp_path))
    assert got.count() == 400 and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_fastq_query_writes_beside_its_rows(spark, sf, tmp_path):
    """As many files as the table has tasks, not two."""
    from strandline.queries_io import fastq_ranges
    from strandline.store import shared_dir

    spark.read.parquet(f"{sf}/documents.parquet").repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        before = set(Path(shared_dir(spark).removeprefix("file:")).glob("fastq-text*/text"))
        assert fastq_ranges(spark, str(tmp_path)).count() > 0
        new = set(Path(shared_dir(spark).removeprefix("file:")).glob("fastq-text*/text")) - before
        assert sum(1 for d in new for f in d.glob("part-*")) > 2
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
