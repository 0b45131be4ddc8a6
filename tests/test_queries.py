"""Every query with SQL gives its rows; edits, history and selections."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.operators import clean, edits
from strandline.plans.history import History
from strandline.plans.selection import Selection

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pairwise_local", "align_mafft", "align_muscle"}  # the kernels have tests of their own
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline" and n not in SLOW)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    want = sorted(map(repr, rel.select(*[f'"{c}"' for c in order]).fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*order).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def seqs(spark, *residues):
    return spark.createDataFrame([("a", i, f"s{i}", r, [1] * len(r), False) for i, r in enumerate(residues)], "aln_id string, row_idx int, id string, residues string, quality array<smallint>, hidden boolean")


def texts(df):
    return [r["residues"] for r in df.orderBy("row_idx").collect()]


def test_edits(spark):
    d = seqs(spark, "ACGT-A", "ACGT", "")
    assert texts(edits.insert_columns(d, 2, 2)) == ["AC--GT-A", "AC--GT--", "--------"]
    assert texts(edits.delete_columns(d, 1, 3)) == ["AT-A", "AT--", "----"]
    assert edits.degap(d).orderBy("row_idx").first()["quality"] == [1] * 5
    assert [r["quality"] for r in edits.pad_rows(d).orderBy("row_idx").collect()][1] == [1, 1, 1, 1, 0, 0]
    more = seqs(spark, "GG")
    assert texts(edits.insert_sequences(d, 1, more)) == ["ACGT-A", "GG", "ACGT", ""]
    assert [r["id"] for r in edits.deduplicate_ids(d.withColumn("id", edits.F.lit("x"))).orderBy("row_idx").collect()] == ["x", "x_2", "x_3"]
    assert texts(edits.reverse_complement_rows(d, [0], "DNA"))[0] == "T-ACGT"
    assert edits.rename(d, 1, "new name").where("row_idx = 1").first()["id"] == "new"


def test_edits_keep_scores_in_step(spark):
    d = seqs(spark, "ACGT", "AC")
    for new in (edits.insert_gap(d, 1, 1), edits.delete_at(d, 0, 3), edits.set_residue(d, 1, 3, "T"), edits.insert_gap(d, 1, 5, strict=True), edits.insert_columns(d, 4, 2), edits.insert_columns(d, 9, 2)):
        assert all(len(r["residues"]) == len(r["quality"]) for r in new.collect())
    assert texts(edits.insert_gap(d, 1, 5, strict=True)) == ["ACGT", "AC----"]
    assert edits.delete_at(d, 0, 0).orderBy("row_idx").first()["quality"] == [1, 1, 1]


def test_places_outside(spark):
    d = seqs(spark, "ACGT", "AC")
    outside = [
        edits.insert_columns(d, 5, 1, strict=True), edits.delete_columns(d, 2, 5, strict=True), edits.set_residue(d, 2, 0, "A", strict=True),
        edits.insert_gap(d, 2, 0, strict=True), edits.delete_at(d, 1, 2, strict=True), edits.keep_columns(d, spark.createDataFrame([("a", 0, True)], "aln_id string, col int, keep boolean")),
        edits.restore_columns(d, 0, edits.removed_columns(d, 0, 2).where("row_idx = 0")), edits.restore_columns(d.where("row_idx = 0"), 0, edits.removed_columns(d, 0, 2)),
        clean.block_mask(d, "DNA", clean.Blocks(b1=3)), clean.block_mask(d, "DNA", clean.Blocks(b1=2, b2=1)),
    ]
    for df in outside:
        with pytest.raises(Exception, match="out of range|don't suit"):
            df.collect()
    assert texts(edits.insert_columns(d, 4, 1, strict=True)) == ["ACGT-", "AC---"] and texts(edits.delete_columns(d, 2, 4, strict=True)) == ["AC", "AC"]
    for wrong in (lambda: edits.insert_gap(d, -1, 0), lambda: clean.block_mask(d, "DNA", clean.Blocks(b4=1))):
        with pytest.raises(Exception):
            wrong()


def test_deleted_columns_come_back(spark):
    d = seqs(spark, "ACGT-A", "ACG", "")
    back = edits.restore_columns(edits.delete_columns(d, 1, 4), 1, edits.removed_columns(d, 1, 4))
    assert texts(back) == ["ACGT-A", "ACG---", "------"]
    assert back.orderBy("row_idx").first()["quality"] == [1, 0, 0, 0, 1, 1]


def test_history(spark):
    d = seqs(spark, "AC-T")
    h = History(d, limit=2)
    for k in range(4):
        h.apply(f"e{k}", lambda x: edits.insert_columns(x, 0, 1))
    assert h.undo() == "e3" and h.undo() == "e2" and h.undo() is None and h.redo() == "e2" and h.dirty
    assert texts(h.current) == ["---AC-T"]


def test_selection(spark):
    s = Selection((3, 9), (1, 4), "cells", True)
    assert (s.rows(10), s.cols(6), s.cell_count(10, 6)) == (range(1, 4), range(4, 6), 6)
    cells = spark.createDataFrame([(r, c) for r in range(5) for c in range(8)], "row_idx int, col int")
    assert cells.where(s.contains(5, 8)).count() == 3 * 4


def test_equal_ids_of_many_groups(spark):
    """One stream of sorted rows, not a call for each name of each set."""
    d = spark.range(3000).selectExpr("cast(id % 300 as string) as aln_id", "cast(id div 300 as int) as row_idx", "case id div 300 when 3 then 'x_2' when 7 then 'y' else 'x' end as id")
    out = edits.deduplicate_ids(d)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    names = ["x", "x_2", "x_3", "x_2_2", "x_4", "x_5", "x_6", "y", "x_7", "x_8"]
    assert sorted(map(tuple, out.collect())) == sorted((str(a), i, n) for a in range(300) for i, n in enumerate(names))


def test_block_parameters():
    clean.Blocks().validate(10)
    for bad in (clean.Blocks(b1=5), clean.Blocks(b1=8, b2=7), clean.Blocks(b4=1)):
        with pytest.raises(Exception):
            bad.validate(10)


def test_plans_of_many_edits_stay_short(spark):
    import time

    d = spark.createDataFrame([("x", i, f"s{i}", "ACGT-ACGT") for i in range(4)], "aln_id string, row_idx int, id string, residues string")
    h, begin = History(d), time.time()
    for i in range(12):
        h.apply(f"edit {i}", lambda x: edits.insert_columns(x, 2, 1))
    assert h.undo() == "edit 11" and {r["residues"] for r in h.current.collect()} == {"AC" + "-" * 11 + "GT-ACGT"}
    assert time.time() - begin < 60


def test_local_alignments_have_ranges(spark):
    from strandline.operators import align

    d = spark.createDataFrame([("x", 0, "a", "MMMWCHKWCHKMMM"), ("x", 1, "b", "GGWCHKWCHKGGGGG")], "aln_id string, row_idx int, id string, residues string")
    r = align.pairwise_align(d, "protein", "local").first()
    assert ("MMMWCHKWCHKMMM", "GGWCHKWCHKGGGGG")[r["i"]][r["start_i"] : r["end_i"]] == r["row_i"] == "WCHKWCHK" == ("MMMWCHKWCHKMMM", "GGWCHKWCHKGGGGG")[r["j"]][r["start_j"] : r["end_j"]]


def test_presets_and_class_runs(spark):
    from strandline.functions import views

    d = seqs(spark, "--AC-T-", "-GAC-TT", "-GA-ATT")
    assert texts(clean.without_gappy_columns(d)) == ["-ACT-", "GACTT", "GA-TT"]
    assert texts(clean.with_trimmed_ends(d)) == ["-AC-T-", "GAC-TT", "GA-ATT"]
    runs = views.class_runs(seqs(spark, "AA-?C", ""), "DNA").orderBy("start").collect()
    assert [(r["row_idx"], r["start"], r["end"], r["class"]) for r in runs] == [(0, 0, 2, "A"), (0, 2, 4, "gap"), (0, 4, 5, "C")]
