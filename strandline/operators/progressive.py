"""Progressive alignment of sets of any size: a stage of Spark for each round of the guide tree.

The tree is average linkage by rounds: in each, all pairs of clusters that are nearest to each other join at once.
That gives the tree of joining them one by one, as a cluster made of others is never nearer to a third than
they were. Rounds are therefore also the levels of the alignment: all merges of all sets in a round are rows of
one stage. The trees of sets of up to AT_ONCE rows come about in one stage, a set's pairs of rows together.

A profile is a row: the weighted letters and gaps of its columns, without the sequences below it. A merge takes two such
rows and gives their steps and the new profile; it is stored under the round in which its own merge is due, so that a
round reads what it needs and no more. Afterwards the steps are followed from the root down: a node's columns
are places in the root's, its children's follow from them. Last, every sequence is set to its places by itself. No
task ever holds a set: a merge holds two profiles, of the size of their widths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.kernels import msa
from strandline.operators.distances import kmer_distance
from strandline.session import ship_code
from strandline.store import Store

#: A node is its round (0: a row of the set) and its least row.
_ROUND = 32
#: Merges of a task whose profiles are held at once.
LOT = 32
#: Rows of a set whose tree one task makes by itself, from some 2,000 pairs at most.
AT_ONCE = 64
TREE = "aln_id string, node long, left long, right long, round int, height double"
PROFILE = "aln_id string, node long, parent long, side int, weight double, letters binary, freq binary, gap binary"
STEPS = "aln_id string, node long, left long, right long, ops binary"
PLACES = "aln_id string, node long, places binary"


def _tree_of_set(t: pa.Table) -> pa.Table:
    """The merges of one set (aln_id, a, b, d), as guide_rounds gives them, and its rows' weights as merges of round 0."""
    a, b, d0 = (t.column(c).to_numpy() for c in ("a", "b", "d"))
    row, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, (i, j) = len(row), back.reshape(2, -1)
    mass, size = np.zeros((2, n, n))
    mass[i, j] = mass[j, i] = np.minimum(np.nan_to_num(d0, nan=1e300), 1e300)
    size[i, j] = size[j, i] = 1.0
    cluster, node, low, height, weight, out, level = np.arange(n), row.copy(), row.copy(), np.zeros(n), np.zeros(n), [], 0
    while True:
        # Clusters are in order of their least rows, so that the first of equally near ones is that of the first pair.
        d = np.divide(mass, size, out=np.full_like(mass, np.inf), where=size > 0)
        near = d.argmin(axis=1)
        x = np.flatnonzero((near[near] == np.arange(len(d))) & (np.arange(len(d)) < near) & np.isfinite(d.min(axis=1)))
        if not len(x):
            break
        level += 1
        y = near[x]
        count, up = np.bincount(cluster, minlength=len(d)), height.copy()
        up[x] = up[y] = top = d[x, y] / 2
        weight += (np.maximum(0.0, up - height) / count)[cluster]
        out += zip((level << _ROUND) + low[x], node[x], node[y], [level] * len(x), top, strict=True)
        node[x], height = (level << _ROUND) + low[x], up
        to = np.arange(len(d))
        to[y] = x
        keep, to = np.unique(to, return_inverse=True)
        cluster, node, low, height = to[cluster], node[keep], low[keep], height[keep]
        order = np.argsort(to, kind="stable")
        first = np.searchsorted(to[order], np.arange(len(keep)))
        mass, size = (np.add.reduceat(np.add.reduceat(v[np.ix_(order, order)], first, axis=0), first, axis=1) for v in (mass, size))
        np.fill_diagonal(size, 0.0)
    weight = np.maximum(weight / weight.mean(), 1e-4) if weight.mean() > 0 else np.ones(n)
    out += zip(row, row, row, [0] * n, weight, strict=True)
    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)]
    return pa.table([pa.array([t.column("aln_id")[0].as_py()] * len(out), pa.string()), *columns], names=["aln_id", "node", "left", "right", "round", "height"])


def guide_rounds(dist: DataFrame, rows: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The average-linkage tree of each set, as merges (TREE), and for each row its weight (aln_id, row_idx, weight).

    dist: aln_id, i, j, d for each pair of rows; rows: aln_id, row_idx. Of equally near pairs that with the smaller rows is
    first. A row's weight is the sum of the branches above it, each shared among the rows below; mean 1, at least 1e-4.
    """
    sizes = rows.groupBy("aln_id").agg((F.count(F.lit(1)) <= AT_ONCE).alias("_few"))
    member = store.put(rows.join(sizes, "aln_id").select("aln_id", "row_idx", F.col("row_idx").cast("long").alias("node"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height"), F.lit(0.0).alias("weight"), "_few"), "members")
    pairs = dist.select("aln_id", F.least("i", "j").cast("long").alias("a"), F.greatest("i", "j").cast("long").alias("b"), "d", F.lit(1.0).alias("n"))
    pairs = store.put(pairs.join(sizes, "aln_id"), "pairs")
    small = store.put(pairs.where("_few").select("aln_id", "a", "b", "d").groupBy("aln_id").applyInArrow(_tree_of_set, TREE), "trees")
    own = small.where("round = 0").select("aln_id", "node", F.col("height").alias("own"))
    of_small = member.where("_few").join(own, ["aln_id", "node"], "left").select("aln_id", "row_idx", F.coalesce("own", F.lit(1.0)).alias("weight"))
    member, pairs = member.where("NOT _few").drop("_few"), pairs.where("NOT _few").drop("_few")
    tree, n = small.where("round > 0"), 0
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << _ROUND) - 1))
    while not pairs.isEmpty():
        n += 1
        # The nearest pair of each cluster, in an order of pairs that both of its clusters share.
        ends = pairs.withColumn("x", F.explode(F.array("a", "b")))
        near = ends.groupBy("aln_id", "x").agg(F.min(F.struct("d", F.least(low("a"), low("b")).alias("lo"), F.greatest(low("a"), low("b")).alias("hi"), "a", "b")).alias("p"))
        joined = near.groupBy("aln_id", "p").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
        first = F.col("p.a").bitwiseAND(F.lit((1 << _ROUND) - 1)) == F.col("p.lo")
        merges = joined.select("aln_id", (F.lit(n << _ROUND).cast("long") + F.col("p.lo")).alias("node"), F.when(first, F.col("p.a")).otherwise(F.col("p.b")).alias("left"), F.when(first, F.col("p.b")).otherwise(F.col("p.a")).alias("right"), F.lit(n).alias("round"), (F.col("p.d") / 2).alias("height"))
        merges = store.put(merges, "merges")
        tree = tree.unionByName(merges)
        gone = merges.select("aln_id", F.explode(F.array("left", "right")).alias("old"), F.col("node").alias("new"), F.col("height").alias("top"))
        to = lambda df, c: df.join(gone.select("aln_id", F.col("old").alias(c), F.col("new").alias(f"_{c}")), ["aln_id", c], "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")  # noqa: B023, E731
        moved = to(to(pairs, "a"), "b").where("a <> b")
        # Means over the pairs of rows, whatever was joined on either side.
        pairs = store.put(moved.groupBy("aln_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("d"), F.sum("n").alias("n")), "pairs")
        up = member.join(gone.withColumnRenamed("old", "node"), ["aln_id", "node"], "left")
        sizes = up.where("new IS NOT NULL").groupBy("aln_id", "new").agg(F.count(F.lit(1)).alias("_size"))
        up = up.join(sizes, ["aln_id", "new"], "left")
        is_new = F.col("new").isNotNull()
        share = F.greatest(F.lit(0.0), F.col("top") - F.col("height")) / F.col("size")
        member = up.select("aln_id", "row_idx", F.coalesce("new", "node").alias("node"), F.coalesce("_size", "size").alias("size"), F.coalesce("top", "height").alias("height"), (F.col("weight") + F.when(is_new, share).otherwise(0.0)).alias("weight"))
        member = store.put(member, "members") if n % 4 == 0 else member
    mean = member.groupBy("aln_id").agg(F.avg("weight").alias("mean"))
    weight = F.when(F.col("mean") > 0, F.greatest(F.col("weight") / F.col("mean"), F.lit(1e-4))).otherwise(1.0)
    return tree, of_small.unionByName(member.join(mean, "aln_id").select("aln_id", "row_idx", weight.alias("weight")))


class Columns:
    """A profile by its columns alone: weighted letters, weight of gaps, weight of all rows."""

    def __init__(self, freq: np.ndarray, gap: np.ndarray, total: float):
        self.freq, self.gap, self.total, self.width = freq, gap, np.float32(total), len(gap)

    @classmethod
    def of_row(cls, r: dict) -> Columns:
        letters = np.frombuffer(r["letters"], np.uint8)
        if r["freq"] is None:  # a sequence: its letters, one a column
            freq = np.zeros((len(letters), 128), np.float32)
            freq[np.arange(len(letters)), letters] = r["weight"]
            return cls(freq, np.zeros(len(letters), np.float32), r["weight"])
        gap = np.frombuffer(r["gap"], np.float32)
        freq = np.zeros((len(gap), 128), np.float32)
        freq[:, letters] = np.frombuffer(r["freq"], np.float32).reshape(len(gap), len(letters))
        return cls(freq, gap, r["weight"])

    def packed(self) -> tuple[float, bytes, bytes, bytes]:
        letters = np.flatnonzero(self.freq.any(0))
        return float(self.total), letters.astype(np.uint8).tobytes(), np.ascontiguousarray(self.freq[:, letters]).tobytes(), self.gap.tobytes()


def merged(a: Columns, b: Columns, ops: np.ndarray) -> Columns:
    """ops: 0 a column of both, 1 of a alone, 2 of b alone."""
    freq, gap = np.zeros((len(ops), 128), np.float32), np.zeros(len(ops), np.float32)
    for p, skip in ((a, 2), (b, 1)):
        own = ops != skip
        freq[own] += p.freq
        gap[own] += p.gap
        gap[~own] += p.total
    return Columns(freq, gap, a.total + b.total)


def _merges(alphabet: str, params: msa.Params):
    m = params.scores(alphabet)

    def lot(rows: list[dict]) -> Iterator[tuple[dict, Columns, Columns, np.ndarray]]:
        both = [(Columns.of_row(r["l"]), Columns.of_row(r["r"])) for r in rows]
        for r, (a, b), ops in zip(rows, both, msa.align_profile_pairs(both, m, params), strict=True):
            yield r, a, b, np.array(ops, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, a, b, ops in (x for batch in batches for at in range(0, len(batch), LOT) for x in lot(batch.slice(at, LOT).to_pylist())):
            weight, letters, freq, gap = merged(a, b, ops).packed()
            row = {k: r[k] for k in ("aln_id", "node", "left", "right", "parent", "side", "due")}
            yield pa.RecordBatch.from_pylist([row | {"ops": ops.tobytes(), "weight": weight, "letters": letters, "freq": freq, "gap": gap}], schema=_MERGED)

    return run


_MERGED = pa.schema([("aln_id", pa.string()), *[(c, pa.int64()) for c in ("node", "left", "right", "parent")], ("side", pa.int32()), ("due", pa.int32()), ("ops", pa.binary()), ("weight", pa.float64()), *[(c, pa.binary()) for c in ("letters", "freq", "gap")]])
_MERGED_DDL = "aln_id string, node long, left long, right long, parent long, side int, due int, ops binary, weight double, letters binary, freq binary, gap binary"


def _descents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps and places of a node (null: it is the root) to the places of its children, with their rounds."""
    for batch in batches:
        for r in batch.to_pylist():
            ops = np.frombuffer(r["ops"], np.uint8)
            own = np.arange(len(ops), dtype=np.int32) if r["places"] is None else np.frombuffer(r["places"], np.int32)
            out = [{"aln_id": r["aln_id"], "node": r[side], "of": r[side] >> _ROUND, "places": own[ops != skip].tobytes()} for side, skip in (("left", 2), ("right", 1))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("aln_id", pa.string()), ("node", pa.int64()), ("of", pa.int32()), ("places", pa.binary())]))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Residues and scores at their places; all others are gaps."""
    for batch in batches:
        rows, scores = [], []
        for s, q, p, w in zip(*(batch.column(c).to_pylist() for c in ("_plain", "_scores", "_places", "_width")), strict=True):
            at = np.arange(len(s)) if p is None else np.frombuffer(p, np.int32)
            row = np.full(w, ord("-"), np.uint8)
            row[at] = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
            rows.append(row.tobytes().decode())
            own = None if q is None else [0] * w
            for k, x in zip(at.tolist(), q or [], strict=False):
                own[k] = x
            scores.append(own)
        keep = [c for c in batch.schema.names if c not in ("_plain", "_scores", "_places", "_width")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, pa.string()), pa.array(scores, pa.list_(pa.int16()))], [*keep, "_row", "_own"])


def align_levels(seqs: DataFrame, alphabet: str, params: msa.Params | None = None, tree: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """seqs with residues aligned, and quality, if there, in step with them (0 at gaps); all other columns stay as they are.

    Gaps in the input don't count. tree: merges (TREE; a child's round is before its parent's) and weights of rows, instead of
    average linkage over k-mer distances. A row without residues is all gaps; a set with one row with residues keeps it; a
    null counts as empty. The number of stages is twice that of rounds, whatever the number of sets and rows.
    """
    spark = ship_code(seqs.sparkSession)
    params = params or msa.Params()
    store = Store(spark, "levels")
    plain = S.ungapped(F.coalesce("residues", F.lit("")))
    base = store.put(seqs.withColumn("_plain", plain), "rows")
    full = base.where(F.length("_plain") > 0).select("aln_id", "row_idx", F.col("_plain").alias("residues"))
    merges, weights = tree or guide_rounds(kmer_distance(full, alphabet), full, store)
    merges = store.put(merges.select("aln_id", "node", "left", "right", "round"), "tree")
    # Each node's parent, its side there and the round in which that merge is due.
    up = merges.select("aln_id", F.posexplode(F.array("left", "right")).alias("side", "node"), F.col("node").alias("parent"), F.col("round").alias("due"))
    up = store.put(up.select("aln_id", "node", "parent", "side", "due"), "parents")
    leaf = full.join(weights, ["aln_id", "row_idx"]).select("aln_id", F.col("row_idx").cast("long").alias("node"), "weight", F.col("residues").cast("binary").alias("letters"))
    none = F.lit(None).cast("binary")
    store.add(leaf.join(up, ["aln_id", "node"]).withColumns({"freq": none, "gap": none, "round": F.lit(0)}), "profiles", "round", "due")
    merges = store.put(merges.join(up, ["aln_id", "node"], "left"), "merges")
    sizes = {r["round"]: r["n"] for r in merges.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each round
    rounds, cores = max(sizes, default=0), spark.sparkContext.defaultParallelism
    side = lambda k: F.first(F.when(F.col("side") == k, F.struct("weight", "letters", "freq", "gap")), ignorenulls=True).alias("lr"[k])
    for n in range(1, rounds + 1):
        ready = store.part("profiles", PROFILE, round="*", due=n)
        # A task's merges are filled together, LOT at a time.
        parts = min(sizes[n], max(cores, sizes[n] // LOT))
        both = ready.withColumnRenamed("node", "child").withColumnRenamed("parent", "node").repartition(parts, "aln_id", "node").groupBy("aln_id", "node").agg(side(0), side(1))  # two rows
        now = both.join(merges.where(F.col("round") == n), ["aln_id", "node"]).select("aln_id", "node", "left", "right", "parent", "side", "due", "l", "r")
        store.add(now.mapInArrow(_merges(alphabet, params), _MERGED_DDL).withColumns({"round": F.lit(n), "due": F.coalesce("due", F.lit(0))}), "profiles", "round", "due")
    for n in range(rounds, 0, -1):
        steps = store.part("profiles", STEPS, round=n, due="*").join(store.part("places", PLACES, of=n), ["aln_id", "node"], "left")
        store.add(steps.mapInArrow(_descents, "aln_id string, node long, of int, places binary"), "places", "of")
    alone = base.groupBy("aln_id").agg(F.max(F.length("_plain")).alias("_alone"))
    roots = store.part("profiles", STEPS, round="*", due=0).select("aln_id", F.length("ops").alias("_width"))
    width = alone.join(roots, "aln_id", "left")
    places = store.part("places", PLACES, of=0).select("aln_id", F.col("node").cast("int").alias("row_idx"), F.col("places").alias("_places"))
    out = base.join(places, ["aln_id", "row_idx"], "left").join(width.select("aln_id", F.coalesce("_width", "_alone").alias("_width")), "aln_id")
    scores = F.lit(None).cast("array<smallint>")
    if "quality" in seqs.columns:  # those of the residues, if the scores are one a cell
        cells = S.cells_of(F.coalesce("residues", F.lit("")))
        of_residues = F.transform(F.filter(F.arrays_zip(cells.alias("c"), F.col("quality").alias("q")), lambda x: ~x["c"].isin("-", ".", "~")), lambda x: x["q"])
        scores = F.when(F.size("quality") == F.length("residues"), of_residues).otherwise(F.col("quality")).cast("array<smallint>")
    rest = [c for c in seqs.columns if c not in ("residues", "quality")]
    flat = out.select(*rest, "_plain", scores.alias("_scores"), "_places", "_width")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name in rest)
    got = flat.mapInArrow(_set_rows, schema + ", _row string, _own array<smallint>")
    named = {"residues": F.col("_row"), "quality": F.col("_own")}
    return got.select(*[named[c].alias(c) if c in named else c for c in seqs.columns])
