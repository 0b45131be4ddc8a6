"""A Merkle manifest of documents, kept in an external-memory store of nodes.

Leaves are sorted by (source, doc_id) into runs, one a task, and each gets its coordinate: the number of its
source's tree, and its position there. A level of the store holds runs of FANOUT consecutive nodes as one row
(tree, node, hashes), as Parquet under level=<k>. The next level reads it sequentially: consecutive rows of a file are
cut into runs as they stream by, so nothing is shuffled but the few runs that begin in one file and end in another. The
subroots, in the order of their sources, are the leaves of one more tree, whose root is that of the manifest.

Proofs come from merge-scans by coordinate, from the root down: a level's rows meet the paths of their parents, so a
path is made once for each run and not for each leaf, and leaves meet only the path of their own run.
A tree of a third of all rows is spread as any other: keys of joins are (tree, run), of at most FANOUT rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, ascii_lower, keep, placed, text_buffer
from strandline.llm.decontamination import small

FANOUT = 16
#: What a leaf is made of, in this order, and the characters of a digest.
FIELDS, DIGEST = ("doc_id", "source", "lang", "n_chars", "text"), 64
RESULTS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
RUN = "tree long, node long, n long, first long, hashes string"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each column as `bytes:value`, or `-` if null."""
    text = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, pos, n, hash) in the order of a file to rows of RUN; a run that goes on in another file comes in parts."""
    held = None

    def out(t: pa.Table, starts: np.ndarray, end: int) -> pa.RecordBatch:
        _, off = text_buffer(t["hash"])
        data, _ = text_buffer(t["hash"].slice(0, end) if isinstance(t["hash"], pa.Array) else t["hash"].slice(0, end).combine_chunks())
        tree, pos, n = (t[c].to_numpy()[starts] for c in ("tree", "pos", "n"))
        ends = pa.py_buffer(off[np.append(starts, end)].astype(np.int32))
        hashes = pa.Array.from_buffers(pa.string(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays([pa.array(tree), pa.array(pos // FANOUT), pa.array(n), pa.array(pos), hashes], ["tree", "node", "n", "first", "hashes"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        held = None
        if not t.num_rows:
            continue
        tree, pos, n = (t[c].to_numpy() for c in ("tree", "pos", "n"))
        new = np.ones(len(tree), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (pos[1:] != pos[:-1] + 1) | (pos[1:] % FANOUT == 0)
        starts = np.flatnonzero(new)
        last, end = starts[-1], len(tree)
        if pos[-1] % FANOUT != FANOUT - 1 and pos[-1] != n[-1] - 1:
            held, starts, end = t.slice(last), starts[:-1], last
        if len(starts):
            yield out(t, starts, end)
    if held is not None:
        yield out(held.combine_chunks(), np.zeros(1, np.int64), held.num_rows)


def _whole() -> Column:
    return F.octet_length("hashes") == DIGEST * F.least(F.lit(FANOUT), F.col("n") - FANOUT * F.col("node"))


class Level(NamedTuple):
    """A level's rows, in parts as they were cut."""

    cut: DataFrame

    def runs(self) -> DataFrame:
        """tree, node, n (nodes of the tree on this level), hashes: one row for each run."""
        whole = self.cut.where(_whole()).select("tree", "node", "n", "hashes")
        parts = self.cut.where(~_whole()).groupBy("tree", "node", "n").agg(F.sort_array(F.collect_list(F.struct("first", "hashes"))).alias("p"))  # at most FANOUT
        return whole.unionByName(parts.select("tree", "node", "n", F.array_join(F.transform("p", lambda p: p["hashes"]), "").alias("hashes")))


class Forest(NamedTuple):
    """The stored levels of some trees, from the leaves up, and their roots: tree, n (leaves), subroot."""

    levels: list[Level]
    roots: DataFrame


def grow(work: Workspace, leaves: DataFrame, most: int, name: str) -> Forest:
    """Trees over leaves (tree, pos, n, hash), n being the leaves of the tree, `most` the largest such."""
    spark, levels, nodes = work.spark, [], leaves
    roots, size = leaves.where("n = 1").select("tree", F.col("hash").alias("subroot")), most
    while size > 1:
        path = f"{work.path}/{name}/level={len(levels)}"
        nodes.where("n > 1").select("tree", "pos", "n", "hash").mapInArrow(cut_runs, RUN).write.parquet(path)
        level = Level(spark.read.schema(RUN).parquet(path))
        levels.append(level)
        up = level.runs().select("tree", F.col("node").alias("pos"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.sha2("hashes", 256).alias("hash"))
        roots = roots.unionByName(up.where("n = 1").select("tree", F.col("hash").alias("subroot")))
        nodes, size = up, -(-size // FANOUT)
    return Forest(levels, roots)


def _sides(k: Column) -> Column:
    """What stands left and right of node k of a run."""
    at = (k * DIGEST).cast("int")
    return F.struct(F.substring("hashes", F.lit(1), at).alias("left"), F.substring("hashes", at + (DIGEST + 1), F.lit(DIGEST * FANOUT)).alias("right"))


def _height(n: Column) -> Column:
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(16)), F.lit(0))


def descend(work: Workspace, forest: Forest, tops: DataFrame, name: str, down_to: int = 0) -> DataFrame:
    """tree, pos, subroot, path of the nodes of level down_to; path: the siblings (left, right) of each level up to the
    root, beginning with what `tops` (tree, n, subroot, path) has above the tree's own root."""
    tops = tops.withColumn("height", _height(F.col("n")))
    ending = lambda k: tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("pos"), "subroot", "path")
    now = ending(len(forest.levels))
    for k in range(len(forest.levels) - 1, down_to - 1, -1):
        parents = now.withColumnRenamed("pos", "node")
        met = forest.levels[k].runs().join(parents, ["tree", "node"]).withColumn("k", F.explode(F.sequence(F.lit(0), (F.octet_length("hashes") / DIGEST).cast("int") - 1)))
        path = F.concat(F.array(_sides(F.col("k"))), "path")
        below = met.select("tree", (FANOUT * F.col("node") + F.col("k")).alias("pos"), "subroot", path.alias("path"))
        now = work.store(below.unionByName(ending(k)), f"{name}-paths")
    return now


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, start, lambda h, p: digest(p["left"], h, p["right"]))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """RESULTS, tampered, position for each row of docs (doc_id, source, lang, n_chars, text; other columns go).

    altered: text to be checked in place of a row's own (null: its own), as a column of docs. proof_sha256 is the digest
    of all siblings from the leaf's run up to the root; folded_root is what the checked leaf and the original
    siblings give. A null source is a source, before all others; rows of a source that share a doc_id follow each other
    by their leaves, and a null doc_id comes first; equal rows are leaves each. No rows give no rows.
    """
    with Workspace(docs.sparkSession, "merkle") as work:
        own = [F.col(c) for c in FIELDS]
        checked = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf([*own[:-1], altered]))
        rows = work.store(docs.select("doc_id", "source", leaf(own).alias("leaf"), checked.alias("checked"), F.monotonically_increasing_id().alias("u")), "rows")
        leaf_rows = placed(work, rows, ["source", "doc_id", "leaf", "u"], "leaves")
        sources = leaf_rows.groupBy("source").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
        trees = placed(work, sources, ["source"], "sources").select("source", F.col("place").alias("tree"), "begin", "n")
        trees = work.store(trees, "trees")
        most, n_trees = trees.agg(F.max("n"), F.count(F.lit(1))).first()
        # What leads from a run's row to its coordinate: a row for each run and source, so that no key has more rows than a run.
        spans = leaf_rows.select("run", F.col("source").alias("own")).distinct().join(trees, F.col("own").eqNullSafe(F.col("source")))
        spans = work.store(spans.select(F.col("run").alias("r"), F.col("own").alias("s"), "tree", "begin", "n"), "spans")
        n_bytes = spans.agg(F.sum(F.coalesce(F.octet_length("s"), F.lit(0)) + 40)).first()[0] or 0
        leaves = leaf_rows.join(small(spans, n_bytes), (leaf_rows["run"] == spans["r"]) & leaf_rows["source"].eqNullSafe(spans["s"]))
        leaves = leaves.select("doc_id", "leaf", "checked", "tree", (F.col("place") - F.col("begin")).alias("pos"), "n")
        forest = grow(work, leaves.select("tree", "pos", "n", F.col("leaf").alias("hash")), most or 0, "nodes")
        roots = work.store(forest.roots.join(trees.select("tree", "n"), "tree"), "subroots")
        over = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("hash"))
        top = grow(work, work.store(over.repartitionByRange("pos").sortWithinPartitions("pos"), "top-leaves"), n_trees, "top")
        root = top.roots.first()
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        summit = top.roots.select("tree", F.lit(n_trees).cast("long").alias("n"), "subroot", nothing.alias("path"))
        above = descend(work, top, summit, "top").select(F.col("pos").alias("tree"), "path")
        tops = work.store(roots.join(above, "tree"), "tops")
        paths = descend(work, forest, tops, "nodes", 1)
        runs = forest.levels[0].runs().select("tree", "node", "hashes").join(paths.withColumnRenamed("pos", "node"), ["tree", "node"]) if forest.levels else None
        lone = tops.where("n = 1").select("tree", F.lit(0).cast("long").alias("node"), F.lit("").alias("hashes"), "subroot", "path")
        runs = lone if runs is None else runs.select(*lone.columns).unionByName(lone)
        met = leaves.withColumn("node", F.floor(F.col("pos") / FANOUT)).join(runs, ["tree", "node"])
        path = F.when(F.col("n") > 1, F.concat(F.array(_sides(F.col("pos") % FANOUT)), "path")).otherwise(F.col("path"))
        met = met.withColumn("path", path)
        siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
        out = met.select("doc_id", "leaf", "subroot", F.lit(root["subroot"] if root else None).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
                         fold(F.coalesce("checked", "leaf"), F.col("path")).alias("folded_root"), F.col("checked").isNotNull().alias("tampered"), F.col("pos").alias("position"))
        out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
        return keep(out.select(*RESULTS, "tampered", "position"), "merkle-manifest")


def lowered(text: Column, doc_id: Column, every: int = 5) -> Column:
    """The text in ASCII lower case where `every` divides the crc32 of the id in decimals; null elsewhere, and without an id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, ascii_lower(text))
