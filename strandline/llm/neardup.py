"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified.

A text's set are its distinct shingles of SHINGLE words. Register j of its sketch is
floor(1 - log_b(x_j)), x_j the smallest of the exponentially distributed values (rate A) that hashes give
the shingles, truncated to 16 bits: registers of a union are the larger ones of both, and two sets agree
in a register with about their Jaccard similarity. Texts that agree in all registers of a band meet in a
bucket; a pair at the threshold misses all bands with a probability of 10^-5.

No bucket emits all its pairs. Its smallest text is paired with each other one; components of verified
links then tell which buckets are still open, as members of different components haven't been compared.
Where components meet in an open bucket, the estimate is computed for blocks of their registers at once;
only likely pairs leave that step, the likeliest are verified first, and the others where that didn't join
the components.
Texts with one and the same set are one node from the start, however many copies there are.

With exact=True no link is lost to chance: buckets are then the shingles of each set's prefix (the smallest
n - ceil(0.75 n) + 1 hashes; two sets of the similarity share one of them), and estimates don't decide.
It costs a row for each prefix shingle in place of one for each band, and more verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, packed, prepare, row_blocks, salted_join, text_buffer
from strandline.llm.components import components
from strandline.llm.wordhash import SPACE, TO_LOWER, U64, mix, span_hashes, word_spans

SHINGLE = 5
THRESHOLD = (75, 100)
BANDS, BAND = 80, 7
#: Parameters of the sketch: base, rate, largest register.
B, RATE, TOP = 1.001, 20.0, 65_534
#: How many standard errors the estimate may lie below the threshold.
SIGMAS = 4.0
#: Nodes whose registers are compared at once, blocks that meet others in one task, most parts that a side's blocks are dealt to,
#: and likeliest pairs verified first.
BLOCK, TOGETHER, DEAL, FIRST = 128, 4, 64, 8
#: Most ids that are broadcast to pick texts; above, the join shuffles.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(4711)
_MUL = (_rng.integers(0, 1 << 31, BANDS * BAND, dtype=np.int64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, BANDS * BAND, dtype=np.int64).astype(np.uint32)
_PLACE = (_rng.integers(0, 1 << 62, SHINGLE, dtype=np.int64) * 2 + 1).astype(U64)
_BAND_MUL = (_rng.integers(0, 1 << 62, BAND, dtype=np.int64) * 2 + 1).astype(U64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its shingles (a row of fewer words: of all its words)."""
    low = TO_LOWER[data]
    starts, ends, rows = word_spans(low, offsets, SPACE)
    h = span_hashes(low, starts, ends)
    out = []
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - k + 1), U64)
        for j in range(k):
            full += h[j : j + len(full)] * _PLACE[j]
        full = mix(full)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True) + U64(b - a)))
            else:
                out.append(np.zeros(0, U64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch's smallest 32-bit value for each register; hashes: a set, not empty."""
    x = (hashes >> U64(32)).astype(np.uint32)
    m = len(_MUL)
    out = np.full(m, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            step = max(1, 40_000 // len(part))
            for j in range(0, m, step):
                v = _MUL[j : j + step, None] * part
                v += _ADD[j : j + step, None]
                np.minimum(out[j : j + step], v.min(axis=1), out=out[j : j + step])
    return out


def exponential_registers(least: np.ndarray) -> np.ndarray:
    """floor(1 - log_b(x)) of the smallest exponential values, truncated to 0..TOP + 1."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """regs (n, registers) to (n, BANDS) 64-bit keys."""
    with np.errstate(over="ignore"):
        h = (regs.reshape(len(regs), BANDS, BAND).astype(U64) * _BAND_MUL).sum(axis=2) + np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(h)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two register matrices and the sets' sizes."""
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def loglik(j: np.ndarray) -> np.ndarray:
        pu, pv = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(pu + tiny) + less * np.log(pv + tiny) + same * np.log(np.maximum(1 - pu - pv, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(30):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loglik(x) > loglik(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def sketch(docs: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (of the set; null for an empty one), regs, prefix (where exact); docs: doc_id, text."""
    prepare(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                sets = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = np.array([len(s) for s in sets], np.int64)
                least = np.zeros((len(sets), BANDS * BAND), np.uint32)
                fp = np.zeros((2, len(sets)), U64)
                with np.errstate(over="ignore"):
                    for i, s in enumerate(sets):
                        if len(s):
                            least[i] = registers(s)
                            fp[0, i], fp[1, i] = s.sum(), np.bitwise_xor.reduce(mix(s))
                regs = exponential_registers(least)
                none = n == 0
                prefix = [s[: len(s) - -(-num * len(s) // den) + 1].view(np.int64) if exact and len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(fp[0].view(np.int64), mask=none), pa.array(fp[1].view(np.int64), mask=none), pa.array([r.tobytes() for r in regs.astype("<u2")], pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "fp1", "fp2", "regs", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, n_shingles long, fp1 long, fp2 long, regs binary, prefix array<long>")


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u2").reshape(-1, BANDS * BAND)


def _least_estimate(least: float) -> float:
    return least - SIGMAS * float(np.sqrt(least * (1 - least) / (BANDS * BAND)))


def bucket_rows(nodes: DataFrame, exact: bool) -> DataFrame:
    """node, key: one row for each band, or for each shingle of the prefix."""
    if exact:
        return nodes.select("node", F.explode("prefix").alias("key"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keys = band_keys(_matrix(x.column("regs").to_pylist())).view(np.int64)
                yield pa.RecordBatch.from_arrays([x.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))], ["node", "keys"])

    return nodes.select("node", "regs").mapInArrow(kernel, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _likely(work: Workspace, pairs: DataFrame, nodes: DataFrame, least: float, exact: bool) -> DataFrame:
    """Pairs (a, b) whose estimate isn't clearly below the threshold (exact: whose sizes allow it); few a are centres of many."""
    n = nodes.select("node", "n_shingles", *([] if exact else ["regs"]))
    if exact:
        both = salted_join(work, pairs.join(n.toDF("b", "nb"), "b"), n.toDF("a", "na"), ["a"], F.col("b"))
        return both.where(F.least("na", "nb") >= least * F.greatest("na", "nb")).select("a", "b")
    both = salted_join(work, pairs.join(n.toDF("b", "nb", "rb"), "b"), n.toDF("a", "na", "ra"), ["a"], F.col("b"), counts=pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")))
    both = both.where(F.least("na", "nb") >= least * F.greatest("na", "nb"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                ra, rb = (_matrix(x.column(c).to_pylist()) for c in ("ra", "rb"))
                j = joint_estimate(ra, rb, x.column("na").to_numpy().astype(float), x.column("nb").to_numpy().astype(float))
                yield x.filter(pa.array(j >= _least_estimate(least))).select(["a", "b"])

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(kernel, "a long, b long")


def _beside(work: Workspace, rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """rows joined with a stored table that has a row for each key: broadcast up to BROADCAST_IDS rows, else with hot keys split."""
    return rows.join(F.broadcast(few), key, how) if few.count() <= BROADCAST_IDS else salted_join(work, rows, few, [key], F.col(spread), how)


def _between(work: Workspace, rest: DataFrame, members: DataFrame, nodes: DataFrame, least: float, exact: bool) -> DataFrame:
    """Likely pairs between components that meet in a bucket: a, b (a < b), y (which of them is of the smaller
    part), main (the other's component), estimate. rest: key, node, component of open buckets.

    In a bucket the component with most members there is the main one. Where two components meet, all
    members of the smaller are compared with all of the larger, in blocks (group `m` and the larger one), if
    one of them is the bucket's main one or large; small ones that meet beside the same main one are
    compared among each other (group `g` and the main one). Each pair of blocks meets in a part of its own
    (main, left, right), up to DEAL x DEAL of them, so a large component's blocks are spread over many tasks.
    """
    in_key = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = in_key.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    sizes = work.store(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = work.store(_beside(work, in_key.join(main, "key"), sizes, "component", "key").select("key", "main", "component", "size"), "met")
    side = sized.where("component <> main")
    mains = sized.where("component = main").select("key", F.col("component").alias("c2"), F.col("size").alias("s2"))
    large = side.where(F.col("size") > BLOCK).select("key", F.col("component").alias("c2"), F.col("size").alias("s2"))
    met = side.join(mains.unionByName(large), "key").where("component <> c2").select("component", "size", "c2", "s2").distinct()
    swap = F.struct(F.col("s2").alias("n"), F.col("c2").alias("c")) < F.struct(F.col("size").alias("n"), F.col("component").alias("c"))
    meet = met.select(F.when(swap, F.col("component")).otherwise(F.col("c2")).alias("main"), F.when(swap, F.col("c2")).otherwise(F.col("component")).alias("other"))
    meet = work.store(meet.distinct(), "meet")
    full = work.store(members.join(nodes.select("node", "n_shingles", "regs"), "node"), "full")
    entry = F.struct("node", "n_shingles", "regs", "component")
    by_main = F.concat(F.lit("m"), F.col("main").cast("string"))
    large_side = work.store(meet.select(F.col("main").alias("component")).distinct(), "mains")
    xs = _beside(work, full, large_side, "component", "node", "left_semi").withColumn("main", F.col("component"))
    # A component that meets several larger ones goes to each of them.
    partners = work.store(meet.groupBy(F.col("other").alias("component")).agg(F.collect_set("main").alias("mains")), "partners")
    ys = _beside(work, full, partners, "component", "node").withColumn("main", F.explode("mains"))
    small = side.where(F.col("size") <= BLOCK).groupBy("component").agg(F.collect_set("main").alias("mains"))
    among = _beside(work, full, work.store(small, "small"), "component", "node").withColumn("main", F.explode("mains"))
    columns = ("main", "node", "n_shingles", "regs", "component")
    xs, ys, among = (d.select(*columns) for d in (xs, ys, among))
    among = among.withColumn("main", F.concat(F.lit("g"), F.col("main").cast("string")))
    xs, ys = (d.withColumn("main", by_main).unionByName(among) for d in (xs, ys))

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))

    meta = count(xs, "nx").join(count(ys, "ny"), "main")
    deals = [F.least(F.lit(DEAL), F.ceil(F.col(n) / TOGETHER)).cast("int").alias(d) for n, d in (("nx", "dx"), ("ny", "dy"))]
    meta = work.store(meta.select("main", "nx", "ny", *deals), "blocks")

    def blocks(df: DataFrame, name: str, n: str, mine: str, others: str, part: str, other: str) -> DataFrame:
        own = _beside(work, df, meta, "main", "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col(n)))
        own = own.groupBy("main", "block", mine, others).agg(F.collect_list(entry).alias(name))
        return own.select("main", name, F.pmod("block", F.col(mine)).cast("int").alias(part), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))

    left, right = blocks(xs, "xs", "nx", "dx", "dy", "px", "py"), blocks(ys, "ys", "ny", "dy", "dx", "py", "px")
    both = left.join(right, ["main", "px", "py"]).select("main", "xs", "ys")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = -1.0 if exact else _least_estimate(least)
        for x in batches:
            for i in range(x.num_rows):
                main = x.column("main")[i].as_py()
                one, two = x.column("xs")[i].as_py(), x.column("ys")[i].as_py()
                r1, r2 = _matrix([e["regs"] for e in one]), _matrix([e["regs"] for e in two])
                n1, n2 = (np.array([e["n_shingles"] for e in es], float) for es in (one, two))
                id1, id2 = (np.array([e["node"] for e in es], np.int64) for es in (one, two))
                c1, c2 = (np.array([e["component"] for e in es], np.int64) for es in (one, two))
                for k in range(len(two)):
                    near = np.flatnonzero(((r1 == r2[k]).mean(axis=1) >= low - 0.05) & (np.minimum(n1, n2[k]) >= least * np.maximum(n1, n2[k])) & (c1 != c2[k]) & ((id1 < id2[k]) | (main[0] == "m")))
                    if len(near):
                        j = joint_estimate(r1[near], np.broadcast_to(r2[k], (len(near), r2.shape[1])), n1[near], np.full(len(near), n2[k]))
                        near, j = near[j >= low], j[j >= low]
                    if len(near):
                        other = np.full(len(near), id2[k])
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id1[near], other)), pa.array(np.maximum(id1[near], other)), pa.array(other), pa.array(np.full(len(near), main)), pa.array(j)], ["a", "b", "y", "main", "estimate"])

    return both.mapInArrow(kernel, "a long, b long, y long, main string, estimate double")


def _verified(work: Workspace, pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b; stored) whose whole texts' sets have the similarity."""
    ids = work.store(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    both = salted_join(work, pairs.join(texts.toDF("b", "tb"), "b"), texts.toDF("a", "ta"), ["a"], F.col("b"), counts=counts)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            (da, oa), (db, ob) = text_buffer(x.column("ta")), text_buffer(x.column("tb"))
            keep = np.zeros(x.num_rows, bool)
            for lo, hi in row_blocks(oa + ob):
                sa = shingle_sets(da[oa[lo] : oa[hi]], oa[lo : hi + 1] - oa[lo])
                sb = shingle_sets(db[ob[lo] : ob[hi]], ob[lo : hi + 1] - ob[lo])
                for i, (s, t) in enumerate(zip(sa, sb, strict=True), lo):
                    met = len(np.intersect1d(s, t, assume_unique=True))
                    keep[i] = met > 0 and den * met >= num * (len(s) + len(t) - met)
            yield x.filter(pa.array(keep)).select(["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(kernel, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at least the similarity. Null, empty and
    blank texts have empty sets and no links. Rows that share an id are linked, and all of them are kept or none is
    (kept: doc_id = component_id); keep_one() leaves one of them. A null id links with nothing: its component_id
    is null and it is kept. Ties of estimates go by id. Columns besides these two aren't read. No rows give no rows.
    exact: lose no link to chance, at a higher cost.
    """
    with Workspace(docs.sparkSession, "nd") as work:
        return keep(_near_duplicates(work, docs.select("doc_id", "text"), *threshold, exact), "nd-groups")


def _near_duplicates(work: Workspace, docs: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    least = num / den
    sk = work.store(sketch(docs, num, den, exact), "sketch")
    ids = work.store(sk.select("doc_id", "n_shingles", "fp1", "fp2"), "ids")
    set_key = ["fp1", "fp2", "n_shingles"]
    keyed = ids.where(F.col("fp1").isNotNull() & F.col("doc_id").isNotNull())
    sets = work.store(keyed.groupBy(*set_key).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n")), "sets")
    first_of = sets.select(*set_key, F.col("node").alias("doc_id"))
    nodes = sk.join(first_of, [*set_key, "doc_id"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
    nodes = work.store(nodes.select(F.col("doc_id").alias("node"), "n_shingles", "regs", "prefix"), "nodes")
    work.drop(sk)
    # Each document's set has a node. An id with texts of several sets links their nodes with the smallest.
    of = work.store(salted_join(work, keyed, sets.drop("_n"), set_key, F.col("doc_id"), counts=sets.select(*set_key, "_n")).select("doc_id", "node").distinct(), "of")
    assigned = work.store(of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")), "assigned")
    several = assigned.where("a <> b").select("doc_id", "a")
    own_links = of.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    # Buckets with several nodes: the smallest is their centre. A bucket may hold a large share of all nodes.
    rows = bucket_rows(nodes, exact)
    shared = work.store(rows.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    buckets = salted_join(work, rows, shared, ["key"], F.col("node"), counts=shared.select("key", "_n"))
    buckets = work.store(buckets.select("key", "node", "centre", (F.col("_n") > 2).alias("many")), "buckets")
    done = work.store(buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    likely = work.store(_likely(work, done, nodes, least, exact), "likely")
    links = _confirm(work, likely, docs, num, den).unionByName(own_links)
    found = components(work, links)

    members = work.store(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "members")
    many = buckets.where("many").select("key", "node").join(members, "node")
    open_keys = many.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_keys = work.store(open_keys, "open-keys")
    rest = work.store(_beside(work, many, open_keys, "key", "node", "left_semi").select("key", "node", "component"), "open")
    more = work.store(_between(work, rest, members, nodes, least, exact).join(done, ["a", "b"], "left_anti"), "more")
    work.drop(nodes, buckets, rest, likely, done)
    rank = F.row_number().over(Window.partitionBy("y", "main").orderBy(F.desc("estimate"), "a", "b"))
    first = work.store(more.withColumn("_r", rank).where(F.col("_r") <= FIRST).select("a", "b").distinct(), "first")
    new = _confirm(work, first, docs, num, den)
    if not new.isEmpty():
        links = links.unionByName(new)
        found = components(work, links)
    apart = more.select("a", "b").distinct().join(first, ["a", "b"], "left_anti").join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
    apart = work.store(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "last")
    new = _confirm(work, apart, docs, num, den)
    if not new.isEmpty():
        found = components(work, links.unionByName(new))

    # Copies of one set share its node, which may be that of a large share of all rows.
    node_counts = assigned.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    of_doc = salted_join(work, assigned, found.withColumnRenamed("node", "a"), ["a"], F.col("doc_id"), "left", node_counts).select("doc_id", F.coalesce("component", "a").alias("component"))
    repeats = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    out = salted_join(work, ids.select("doc_id", "n_shingles", "fp1"), of_doc, ["doc_id"], F.col("fp1"), "left", repeats).withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _confirm(work: Workspace, pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    return work.store(_verified(work, pairs, docs, num, den), "links")


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, exact: bool = False) -> DataFrame:
    """docs (with doc_id, text) with one row of each group of near-duplicates: that of the smallest id. Of rows that
    share that id one stays, the one with the smallest hash; of rows without an id one of each text stays. Texts
    without words are in no group, but rows that share an id are. All columns stay as they are; no rows give none."""
    rows, unpack = packed(docs, "doc_id", "text")
    with Workspace(docs.sparkSession, "nd") as work:
        found = _near_duplicates(work, docs.select("doc_id", "text"), *threshold, exact)
        gone = keep(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "nd-gone")
        text = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_text")
        again = docs.select(F.col("doc_id").alias("_again"), text).groupBy("_again", "_text").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        again = keep(again, "nd-again")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    stay = rows.join(gone, rows["doc_id"].cast("long") == gone["_gone"], "left_anti")
    if again.isEmpty():
        return stay.select(*unpack(stay))
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    stay = stay.withColumn("_text", text)
    same = stay["doc_id"].eqNullSafe(again["_again"]) & stay["_text"].eqNullSafe(again["_text"])
    single = stay.join(again, same, "left_anti").select("doc_id", "text", "_rest")
    doubled = stay.join(again, same, "left_semi").groupBy("doc_id", "_text").agg(F.min_by(F.struct("doc_id", "text", "_rest"), F.xxhash64("text")).alias("_one")).select("_one.*")
    out = single.unionByName(doubled)
    return out.select(*unpack(out))
