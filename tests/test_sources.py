"""Formats: contents, errors, sniffing, files and streams."""

import pytest

from strandline.errors import FormatError, ParseError
from strandline.sources import parsers as P
from strandline.sources import reader, writers


def rows(text, format):
    return [(r.id, r.residues) for r in P.parse(text.encode(), format).records]


def test_fasta():
    got = P.parse(b"\xef\xbb\xbf;note\r\n>a first one\r\nAC g.1\r\n~T\n>b\n", "fasta").records
    assert [(r.id, r.description, r.residues) for r in got] == [("a", "first one", "ACg--T"), ("b", "", "")]
    for bad, line in (("ACGT\n>a\n", 1), ("", 1)):
        with pytest.raises(ParseError) as e:
            P.parse(bad.encode(), "fasta")
        assert e.value.line == line


def test_fastq():
    got = P.parse(b"@a x\nACGT\n+a x\nII!I\n@b\nAC\nGT\n+\nIII\nI\n", "fastq").records
    assert [(r.residues, r.quality) for r in got] == [("ACGT", [40, 40, 0, 40]), ("ACGT", [40] * 4)]
    assert P.parse(b"@a\nAC\n+\nhB\n", "fastq").records[0].quality == [40, 2]
    with pytest.raises(ParseError) as e:
        P.parse(b"@a\nAC\n+\nIII\n", "fastq")
    assert e.value.line == 1


def test_phylip():
    assert rows("2 6\nname one  ACG\nname two  AAA\n\nTTT\nCCC\n", "phylip") == [("name one", "ACGTTT"), ("name two", "AAACCC")]
    assert rows("2 6\na_very_long_name ACGTTT\nb AAACCC\n", "phylip") == [("a_very_long_name", "ACGTTT"), ("b", "AAACCC")]
    assert rows("2 6\na ACG\nb AAA\na TTT\nb CCC\n", "phylip-relaxed") == [("a", "ACGTTT"), ("b", "AAACCC")]
    assert rows("2 6\na ACG\n  TTT\nb AAA\n  CCC\n", "phylip-relaxed")[0][0] == "a"
    with pytest.raises(ParseError):
        P.parse(b"2 6\na ACG\n", "phylip-relaxed")


def test_nexus():
    text = "#NEXUS [x [nested]]\nbegin taxa; end;\nBegin Data;\nDimensions ntax=2 nchar=8;\nFormat datatype=DNA gap=. missing=N matchchar=@ interleave=yes;\nMatrix\n'it''s' ACGT\nb @@.N\n\n'it''s' TTTT\nb AAAA\n;\nend;\nbegin sets; x; end;\n"
    p = P.parse(text.encode(), "nexus")
    assert [(r.id, r.residues) for r in p.records] == [("it's", "ACGTTTTT"), ("b", "AC-?AAAA")] and p.alphabet == "DNA"
    with pytest.raises(ParseError):
        P.parse(b"#NEXUS\nbegin data;\nmatrix\na AC\n", "nexus")
    with pytest.raises(ParseError):
        P.parse(text.replace("ntax=2", "ntax=3").encode(), "nexus")


def test_blocks_of_names():
    assert rows("CLUSTAL W\n\na  ACG 3\nb  A-G 2\n   * *\n\na  TT 5\nb  TA 4\n   *.\n", "clustal") == [("a", "ACGTT"), ("b", "A-GTA")]
    assert rows("# STOCKHOLM 1.0\n#=GF ID x\na ACG\nb A.G\n\na UU\nb UA\n//\nc x\n", "stockholm") == [("a", "ACGUU"), ("b", "A-GUA")]
    assert rows("PileUp\n MSF: 5 Type: P\n Name: b Len: 5\n Name: a Len: 5\n//\n   1   5\na AC.TT\nb AAAAA\n", "msf") == [("b", "AAAAA"), ("a", "AC-TT")]
    got = P.parse(b"LOCUS X1 12 bp\nDEFINITION  Some\n            gene.\nFEATURES x\n     source 1\nORIGIN\n   1 acgt acgt\n   9 ac\n//\nLOCUS X2\nORIGIN\n 1 gg\n//\n", "genbank").records
    assert [(r.id, r.description, r.residues) for r in got] == [("X1", "Some gene", "acgtacgtac"), ("X2", "", "gg")]
    with pytest.raises(ParseError):
        P.parse(b"Name: a\n", "msf")
    with pytest.raises(FormatError):
        P.parse(b"", "docx")


def test_sniffing():
    for text, want in {
        "\n\n#nexus\n": "nexus", "# STOCKHOLM 1.0": "stockholm", "MUSCLE CLUSTAL": "clustal", "LOCUS a": "genbank", "!!AA": "msf", ">a": "fasta", ";c\n>a": "fasta", "@a\nAC\n+\nII": "fastq",
        "2 4\nabcdefghijACGT\n": "phylip-relaxed", "2 4\nabc       ACGT\n": "phylip", "2 4\nabc ACGT\n": "phylip-relaxed", "hello": None, "": None,
    }.items():
        assert P.sniff(text.encode()) == want, text
    assert (P.format_of_path("/x/a.fa.txt"), P.format_of_path("b.PHY"), P.format_of_path("c")) == ("fasta", "phylip", None)


def test_strict_names(spark):
    assert writers.strict_names(["Drosophila one", "Drosophila two", "Drosophila", "x"]) == ["Drosophila", "Drosophil2", "Drosophil3", "x"]
    d = spark.createDataFrame([("a", 0, "Drosophila one", "ACG"), ("a", 1, "Drosophila two", "A-G")], "aln_id string, row_idx int, id string, residues string")
    text = writers.render(d, "phylip").first()["text"]
    assert text == "2 3\nDrosophilaACG\nDrosophil2A-G\n" and [r.id for r in P.parse(text.encode(), "phylip").records] == ["Drosophila", "Drosophil2"]


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.fa").write_text(">a d\nAC\n>b\nA\n")
    (folder / "two.nex").write_text("#NEXUS\nbegin data; matrix x AC y GT; end;")
    (folder / "bad.fa").write_text(">a\nAC\n")
    got = reader.read_sequences(spark, str(folder)).orderBy("aln_id", "row_idx").collect()
    assert [(r["aln_id"], r["id"]) for r in got if r["aln_id"] == "one"] == [("one", "a"), ("one", "b")]
    (folder / "bad.fa").write_text("@a\nAC\n+\nIII\n")
    bad = [r for r in reader.read_sequences(spark, str(folder), permissive=True).collect() if r["error"]]
    assert [r["aln_id"] for r in bad] == ["bad"]
    from strandline.streaming import stream_sequences

    q = stream_sequences(spark, str(folder)).writeStream.format("memory").queryName("seqs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seqs").where("error is null").count() >= 3
    rows = reader.read_sequences(spark, f"{folder}/one.fa")
    assert reader.paste_fasta(rows.select("aln_id", "row_idx", "id", "residues"), ">n\nGG\n").where("id = 'n'").first()["row_idx"] == 2
    with pytest.raises(Exception, match="unequal length"):
        writers.stockholm(rows).collect()
    writers.write(rows, str(tmp_path / "out"), "fasta")
    assert any("AC" in f.read_text() for f in (tmp_path / "out").rglob("part-*"))


def test_nexus_datatype_is_that_of_each_alignment(spark):
    d = spark.createDataFrame([("d", 0, "a", "ACGTACGTAC"), ("d", 1, "b", "ACGTACGTAA"), ("p", 0, "a", "MKVLAWYRHE"), ("r", 0, "a", "ACGUUGCAUU")], "aln_id string, row_idx int, id string, residues string")
    text = {r["aln_id"]: r["text"] for r in writers.render(d, "nexus").collect()}
    assert ["datatype=" + x in text[k] for k, x in (("d", "dna"), ("p", "protein"), ("r", "rna"))] == [True] * 3


def test_long_genbank_records_are_joined_once():
    lines = "".join(f"{i * 60 + 1:>9} acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt acgtacgtac gtacgtacgt\n" for i in range(30_000))
    out = P.parse_genbank(f"LOCUS       X 1\nDEFINITION  one\n            two.\nORIGIN\n{lines}//\n")
    assert (out[0].description, len(out[0].residues)) == ("one two", 1_800_000)


def test_interleaved_layouts_and_line_ends(spark):
    d = spark.createDataFrame([("a", 0, "one", "ACGTACGT"), ("a", 1, "second", "AC-TACGA")], "aln_id string, row_idx int, id string, residues string")
    text = {f: writers.render(d, f, interleaved=True, block_width=3).first()["text"] for f in ("phylip", "phylip-relaxed", "nexus", "stockholm")}
    assert text["phylip-relaxed"] == "2 8\none    ACG\nsecond AC-\n\nTAC\nTAC\n\nGT\nGA\n"
    assert text["stockholm"] == "# STOCKHOLM 1.0\n\none     ACG\nsecond  AC-\n\none     TAC\nsecond  TAC\n\none     GT\nsecond  GA\n//\n"
    assert "interleave=yes" in text["nexus"]
    for f, t in text.items():
        assert rows(t, f) == [("one", "ACGTACGT"), ("second", "AC-TACGA")], f
    for f in ("fasta", "clustal", "nexus"):
        t = writers.render(d, f, crlf=True).first()["text"]
        assert t.count("\r\n") == t.count("\n") > 2 and rows(t, f) == [("one", "ACGTACGT"), ("second", "AC-TACGA")]


def test_long_rows_in_one_pass(spark):
    """A row of a million residues is wrapped, and 30,000 columns are kept, in time that grows with their number."""
    import time

    from pyspark.sql import functions as F

    from strandline.functions import views
    from strandline.operators import edits
    from strandline.sources import writers

    row = lambda n: "".join("ACGT-"[(i * i + i // 7) % 5] for i in range(n))
    began = time.time()
    long = row(1_000_000)
    df = spark.createDataFrame([("a", 0, "x", long), ("b", 0, "y", ""), ("c", 0, "z", "é🙂" * 61)], "aln_id string, row_idx int, id string, residues string")
    got = {r["aln_id"]: r["text"] for r in writers.fasta(df).collect()}
    assert got["a"] == ">x\n" + "".join(long[i : i + 60] + "\n" for i in range(0, len(long), 60))
    assert got["b"] == ">y\n" and got["c"].split("\n")[1:-1] == [("é🙂" * 61)[i : i + 60] for i in range(0, 122, 60)]
    wide = [row(30_000), row(29_000)]
    seqs = spark.createDataFrame([("a", i, f"s{i}", s, [j % 90 for j in range(len(s))]) for i, s in enumerate(wide)], "aln_id string, row_idx int, id string, residues string, quality array<smallint>")
    mask = spark.range(30_000).select(F.lit("a").alias("aln_id"), F.col("id").cast("int").alias("col"), (F.col("id") % 7 > 2).alias("keep"))
    out = {r["row_idx"]: r for r in edits.keep_columns(seqs, mask).collect()}
    for i, s in enumerate(wide):
        assert out[i]["residues"] == "".join(c for j, c in enumerate(s.ljust(30_000, "-")) if j % 7 > 2)
        assert out[i]["quality"] == [j % 90 if j < len(s) else 0 for j in range(30_000) if j % 7 > 2]
    runs = [(r["start"], r["end"], r["class"]) for r in views.class_runs(seqs.where("row_idx = 0"), "DNA").orderBy("start").collect()]
    assert "".join((c if c != "gap" else "-") * (e - s) for s, e, c in runs) == wide[0] and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(runs, runs[1:], strict=False))
    assert time.time() - began < 60
