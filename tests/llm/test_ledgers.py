"""Quality ledger, hard negatives and Merkle manifest against plain loops, on edge rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, merkle, negatives, quality, queries
from strandline.llm.common import Workspace, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 991}" for i in range(60_000))
CLASH = "n_words int, failures string, kept int, w int, h int, s int, lines int, `a b` int, _rest int"
EDGE = [
    (1, None), (1, None), (None, None), (None, "no id"), (2, ""), (3, " \t\n"), (4, "\n\n\n"), (5, "a b c a b c a b"), (5, "another under one id"),
    (6, "same line\nsame line\n\nsame line\n same line"), (7, "ä ß 漢字 🙂 #$ a|b <x>"), (8, LONG), (9, "* a\n- b\n• c..."), (10, "x y\x0bz\x0cq\rr s t"), (11, "12 34 -- 5a…\nend…"),
]


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    letters = sum(any(c.isalpha() for c in x) for x in w)
    bullets = sum(bool(re.match(r"[\x20\x09-\x0D]*[*•-]", x)) for x in lines)
    cuts = sum(x.rstrip(" \t\n\x0b\f\r").endswith(("...", "…")) for x in lines)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit), letters, bullets, cuts


def bits(m):
    n, chars, symbols, lines, dup, rep, letters, bullets, cuts = m
    fails = [n < 50, 100 * rep > 50 * n, n > 100_000, chars < 3 * n, chars > 10 * n, 10 * symbols > n, 100 * dup > 30 * lines, 100 * letters < 80 * n, 100 * bullets > 90 * lines, 100 * cuts > 30 * lines]
    return sum(1 << i for i, f in enumerate(fails) if f)


def gone(failures, policy):
    return bool(failures & policy.hard) or (failures & policy.soft).bit_count() > policy.allowed


def test_quality_edges(spark):
    rows = [(i, t, 1, "x", 2, 3, 4, 5, 6, 7, 8) for i, t in EDGE]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)
    out = quality.judge(quality.ledger(docs))
    assert [c for c in out.columns if c in ("w", "h", "s", "lines", "a b", "_rest")] == ["w", "h", "s", "lines", "a b", "_rest"]
    key = lambda r: tuple(map(repr, r))
    want = []
    for i, t in EDGE:
        m = plain(t)
        b = bits(m)
        want.append((i, *m, b, bool(b & 3), not (b & 3 or gone(b, quality.POLICIES["v1"]))))
    got = [tuple(r[c] for c in ("doc_id", *quality.MEASURES, "failures", "base_failed", "kept")) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    none = quality.judge(quality.ledger(docs.limit(0)))
    assert none.collect() == [] and none.columns == out.columns
    assert quality.ablations(none).collect() == []


def test_quality_policies(spark, sf):
    """Policies and ablations read the ledger alone, and say what plain loops over its masks say."""
    entries = quality.ledger(table(spark, sf, "documents"))
    assert "text" not in entries.columns
    plan = quality.ablations(entries, "v1", "source")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "Python" not in plan
    rows = entries.collect()
    for version, policy in quality.POLICIES.items():
        judged = {(r["doc_id"]): r for r in quality.judge(entries, version).collect()}
        for r in rows:
            f = r["failures"]
            sole = [x for i, x in enumerate(quality.RULES) if f >> i & 1 and gone(f, policy) and not gone(f & ~(1 << i), policy)]
            assert judged[r["doc_id"]]["sole_rule"] == (sole[0] if len(sole) == 1 else None)
            assert judged[r["doc_id"]]["kept"] == (not gone(f | 0, policy) and not f & 3)
        for got in quality.ablations(entries, version, "source").collect():
            i, mine = quality.RULES.index(got["rule"]), [r for r in rows if r["source"] == got["source"]]
            alone = [r for r in mine if gone(r["failures"], policy) and not gone(r["failures"] & ~(1 << i), policy)]
            assert got["n_failed"] == sum(r["failures"] >> i & 1 for r in mine) and got["n_removed"] == sum(gone(r["failures"], policy) for r in mine)
            assert (got["n_sole"], got["words_sole"]) == (len(alone), sum(r["n_words"] for r in alone))
            ever, always = 0, -1
            for r in mine:
                ever, always = ever | r["failures"], always & r["failures"]
            assert [got["ever_failed"], got["always_failed"]] == [",".join(x for j, x in enumerate(quality.RULES) if m >> j & 1) for m in (ever, always)]
    c = quality.changes(entries, "base", "v1").first()
    base, v1 = (sum(gone(r["failures"], quality.POLICIES[v]) for r in rows) for v in ("base", "v1"))
    assert c["lost"] == v1 - base and c["gained"] == 0 and c["removed"] == base and c["lost"] + c["kept"] + c["removed"] == len(rows)


def test_quality_keeps_clean_texts(spark, sf):
    """No text that is labelled good and passes the base goes; most that are labelled bad do."""
    got = quality.judge(quality.ledger(table(spark, "/root/testdata/sf0.01", "documents"))).join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where(~F.col("base_failed"))
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * n[0, False] and n[1, True] > 100


def brute(rows, chosen, positives=5, negs=3):
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not chosen(i):
            continue
        dot = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: B023, E731
        rest = sorted((-dot(w), j, m) for n, (j, m, w) in enumerate(rows) if n != k)
        for s, j, _ in [x for x in rest if x[2] == label][:positives]:
            fits = [(j2, -s2) for s2, j2, m in rest if m != label and -50 * s <= -100 * s2 <= -95 * s][:negs]
            out += [(i, j, r + 1, j2, -s, s2) for r, (j2, s2) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


SHAPES = ["clusters", "ties", "equal", "huge", "spread", "zero"]


@pytest.mark.parametrize("shape", SHAPES)
def test_negatives(spark, monkeypatch, shape):
    """All shapes give what plain loops give, over many segments and blocks of anchors."""
    rng = random.Random(SHAPES.index(shape))
    centre = [[rng.gauss(0, 60) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(260):
        v = [int(rng.gauss(x, 9)) for x in centre[rng.randrange(8)]]
        v = {"ties": [x // 30 for x in v], "equal": [3, 1, 4, 1, 5, 9], "huge": [x << 18 for x in v], "zero": [0] * 6}.get(shape, v)
        v = [x * rng.choice([1, 1, 20]) for x in v] if shape == "spread" else v
        rows.append((i // 2 if shape == "ties" else i, rng.randrange(3) if i % 3 else 0, v[: 6 - i % 2] if shape == "spread" else v))
    monkeypatch.setattr(negatives, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(negatives, "KERNEL_ROWS", 4)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 6 * 8 * 5)
    df = spark.createDataFrame([(i, m, v, 9) for i, m, v in rows], "vec_id long, label long, v array<long>, uid int").repartition(3)
    assert mined(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.4, 0.4]), (2, 2, [0.3, 0.3]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (None, 1, [1.0, 1.0]), (8, 2, []), (50, 3, [0.2, 0.1]), (50, 3, [0.2, 0.1]), (9, 1, [-0.001, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    whole = negatives.whole_numbers(df)
    assert sorted((r["vec_id"], tuple(r["v"])) for r in whole.collect()) == [(0, (128, 128)), (1, (102, 102)), (2, (76, 76)), (8, ()), (9, (-1, 0)), (50, (51, 25)), (50, (51, 25))]
    clean = [(r["vec_id"], r["label"], r["v"]) for r in whole.collect()]
    assert mined(negatives.hard_negatives(whole, F.col("vec_id") % 50 == 0)) == brute(clean, lambda i: i % 50 == 0)
    for some in (whole.limit(0), whole.where("vec_id = 0"), whole.where("label = 1")):
        assert negatives.hard_negatives(some, F.col("vec_id") % 50 == 0).collect() == []


def test_negatives_skip_far_segments(spark, monkeypatch):
    """Where vectors lie in groups, anchors read a part of the segments, and certify with it."""
    monkeypatch.setattr(negatives, "SEGMENT_ROWS", 32)
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 400, (40, 8))
    v = (centre[np.arange(2000) % 40] + rng.normal(0, 4, (2000, 8))).astype(int)
    df = spark.createDataFrame([(i, int(i // 40) % 2, x.tolist()) for i, x in enumerate(v)], "vec_id long, label long, v array<long>")
    with Workspace(spark, "t") as work:
        index = negatives.Index(work, df)
        segments = [(r["pivot"], r["lo"], r["hi"]) for r in index.segments.collect()]
        block = next(index.blocks(F.col("vec_id") % 50 == 0))
        seen = []
        meets, scan = negatives._meets, negatives._scan
        monkeypatch.setattr(negatives, "_scan", lambda space, shared: seen.append(shared.value) or scan(space, shared))
        index.search(block, np.full((40, 1), negatives.LEAST), np.full((40, 1), negatives.MOST), True, 5)
        assert len(seen) <= 4
        read = sum(int((meets(b.far[:, p], b.new, lo, hi, index.space.slack) & ~meets(b.far[:, p], b.old, lo, hi, index.space.slack)).sum()) for b in seen for p, lo, hi in segments)
        assert read < 0.25 * 40 * len(segments)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root, and for each node its siblings as (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            r = runs[i // 16]
            paths[k].append(("".join(r[: i % 16]), "".join(r[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def plain_manifest(rows):
    leaf = lambda r: H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        sub, paths = trees[s]
        for r, p in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), paths, strict=True):
            path, changed = p + top, r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if changed else leaf(r)
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf(r), sub, root, H(*[x for pair in path for x in pair]), h, h == root))
    return out


def manifest_rows(df):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.lowered(F.col("text"), F.col("doc_id"))).select(*merkle.RESULTS).collect()), key=repr)


def test_merkle(spark, monkeypatch):
    """Trees of one, 16, 17, 256, 257 and 700 leaves, a null source, null and repeated ids, equal rows; files cut anywhere."""
    rng = random.Random(5)
    rows = []
    for source, n in [("one", 1), ("z", 16), ("a", 17), ("Ä", 256), (None, 257), ("hot", 700), ("", 3)]:
        rows += [(rng.randrange(10**6), source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "Text Of Words", "ä B"])) for _ in range(n)]
    rows += [(None, "hot", None, None, "Null Id"), (None, "hot", None, None, "Null Id"), (7, "hot", "x", 1, "Twice"), (7, "hot", "x", 1, "Twice"), (7, "hot", "x", 1, "Other")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(5)
    monkeypatch.setattr(common, "BATCH_ROWS", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert manifest_rows(df) == sorted(plain_manifest(rows), key=repr)
        for some in (rows[:1], rows[:17]):
            assert manifest_rows(spark.createDataFrame(some, "doc_id long, source string, lang string, n_chars long, text string")) == sorted(plain_manifest(some), key=repr)
        assert manifest_rows(df.limit(0)) == []
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merkle_runs():
    """Rows in file order, in batches and files of any size, give the same runs, whole or in parts that make them up."""
    rng = random.Random(1)
    rows = [(t, p, n) for t, n in ((0, 1), (1, 40), (2, 16), (5, 33)) for p in range(n)]
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randrange(0, 9)))
        batches = [pa.RecordBatch.from_pylist([{"tree": t, "pos": p, "n": n, "hash": H(str((t, p)))} for t, p, n in rows[a:b]]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        files = [batches[: len(batches) // 2], batches[len(batches) // 2 :]]
        got = {}
        for f in files:
            for b in merkle.cut_runs(iter(f)):
                for r in b.to_pylist():
                    got.setdefault((r["tree"], r["node"]), []).append((r["first"], r["hashes"]))
        want = {}
        for t, p, _ in rows:
            want[t, p // 16] = want.get((t, p // 16), "") + H(str((t, p)))
        assert {k: "".join(h for _, h in sorted(v)) for k, v in got.items()} == want
        assert sum(len(v) for v in got.values()) <= len(want) + 1


@pytest.mark.parametrize("name", ["op11_quality", "op12_negatives", "op13_merkle"])
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(found.fetchall(), key=repr)
