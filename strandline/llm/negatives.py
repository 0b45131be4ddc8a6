"""Hard negatives by exact top-k search over one-dimensional distance keys.

Vectors of whole numbers get one more component, so that all have the same length; the largest inner product with an
anchor is then the least distance. Each is stored under (pivot, distance): its nearest of PIVOTS reference points
and its distance from that, in sorted segments. By the triangle inequality, vectors within r of an anchor have keys
within r of the anchor's own distance from the pivot. A search scans the segments that meet this interval of each pivot,
then those of a wider one, until no vector outside can have a score above the k-th best found: its distance
would be over r. A radius that makes this certain is known once k are found, so few rounds are needed; the last
radius covers all, whatever the data.

Two searches follow each other: an anchor's best of its own label, then, below the score of each of these, the best of
other labels (an annulus: the inner radius is that of the highest score allowed, the outer that of the lowest).

Anchors are taken in blocks of at most BLOCK_BYTES, in the order of their keys, against all segments: a block is
broadcast, each segment is read by one task, and what the driver gets back of a block is a count and the k-th best
score for each anchor. Candidates and results are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, placed

#: Reference points, and the rows they are fitted on (a bounded sample, by hash; it bears on speed alone).
PIVOTS, SAMPLE_ROWS = 64, 4096
#: Rows of the sample that first radii are guessed from.
SEEN_ROWS = 256
SEGMENT_ROWS = 1024
#: Most bytes of the vectors of one block of anchors.
BLOCK_BYTES = 16 << 20
#: Anchors that a kernel takes at once.
KERNEL_ROWS = 2048
#: Slack of distances, relative and as a share of the longest vector, far over their rounding.
SLACK, SHARE = 1e-9, 1e-6
SEGMENT = "pivot int, lo double, hi double, rows int, uids binary, ids binary, labels binary, vectors binary"
FOUND = "uid long, anchor_id long, slot int, id long, score long"
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(vectors: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, label (long), v: floor(scale * x) of each component; rows with a null id or label, a null vector, or a null
    or non-finite component are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(~bad)
    return good.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows; shorter ones are filled with 0."""
    n, off = np.asarray(col.value_lengths()), col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    out = np.zeros((len(col), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat
    return out


class Space(NamedTuple):
    """What tells distances: the components of a vector, the largest square of a length, the reference points (with the added component)."""

    dims: int
    most: int
    large: int
    pivots: np.ndarray

    def exact_float(self, rows: int = SEGMENT_ROWS) -> bool:
        """Whether scores, times the rows of a segment, are whole in doubles."""
        return self.large * self.large * max(self.dims, 1) * rows < 1 << 52

    def augmented(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented rows from the pivots."""
        far = (x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1)
        return np.sqrt(np.maximum(far, 0))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])

    @property
    def slack(self) -> float:
        return SHARE * max(1.0, float(self.most) ** 0.5)

    @property
    def kind(self) -> type:
        return next(t for t in (np.int16, np.int32, np.int64) if self.large <= np.iinfo(t).max)


def space_of(vectors: DataFrame) -> tuple[Space, np.ndarray, np.ndarray]:
    """The space of all vectors, with pivots fitted on the sample; and that sample (labels, vectors)."""
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    most, dims, large = vectors.agg(F.max(square), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    got = vectors.select("label", "v", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("label", "v").toArrow().combine_chunks()
    dims, large = dims or 0, large or 0
    v = matrix(got["v"].chunk(0), dims) if got.num_rows else np.zeros((0, dims), np.int64)
    space = Space(dims, most or 0, large, np.zeros((1, dims + 1)))
    x = space.augmented(v)
    k = max(1, min(PIVOTS, len(x) // 16))
    points = x[np.linspace(0, len(x) - 1, k).astype(int)] if len(x) else space.pivots
    for _ in range(8 if len(x) else 0):
        near = space._replace(pivots=points).to_pivots(x).argmin(1)
        sums, n = np.zeros_like(points), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points)
    return space._replace(pivots=points), got["label"].to_numpy() if got.num_rows else np.zeros(0, np.int64), v


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = space.to_pivots(space.augmented(matrix(b.column("v"), space.dims)))
            near = far.argmin(1) if len(far) else np.zeros(0, int)
            yield b.append_column("pivot", pa.array(near.astype(np.int32))).append_column("key", pa.array(far[np.arange(len(far)), near]))

    return run


def _segments(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in _then_none(batches):
            t = pa.Table.from_batches([b]) if b is not None else None
            t = held if t is None else t if held is None else pa.concat_tables([held, t])
            held = None
            if t is None or not t.num_rows:
                continue
            t = t.combine_chunks()
            pivot = t["pivot"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]
            out = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for at in range(lo, hi, SEGMENT_ROWS):
                    n = min(SEGMENT_ROWS, hi - at)
                    if b is not None and at + n == len(pivot) and n < SEGMENT_ROWS:
                        held = t.slice(at)
                        break
                    part = t.slice(at, n).combine_chunks()
                    order = np.argsort(part["vec_id"].to_numpy(), kind="stable")  # of equal scores the smaller id is first
                    key = part["key"].to_numpy()
                    whole = [part[c].to_numpy()[order].astype(np.int64).tobytes() for c in ("uid", "vec_id", "label")]
                    out.append((int(pivot[at]), float(key.min()), float(key.max()), n, *whole, matrix(part["v"].chunk(0), space.dims)[order].astype(space.kind).tobytes()))
            if out:
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])

    return run


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


class Block(NamedTuple):
    """Anchors and what is sought of them. old, new: the radii before and in this round (none: -1); lo, hi (anchors x slots): the
    scores a slot takes; same: whether its rows have the anchor's label or another."""

    uids: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    far: np.ndarray
    old: np.ndarray
    new: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool
    k: int


def _meets(far: np.ndarray, r: np.ndarray, lo: float, hi: float, slack: float) -> np.ndarray:
    """Of anchors so far from a pivot, those whose keys within r of theirs meet lo to hi."""
    wide = r * (1 + SLACK) + slack
    return (r >= 0) & (lo <= far + wide) & (hi >= far - wide)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k highest allowed scores of each row, of equal ones the earlier column, and whether they are allowed at all."""
    n = scores.shape[1]
    k = min(k, n)
    if exact:  # score and place as one number
        value = np.where(allowed, scores * n + (n - 1 - np.arange(n)), -np.inf)
        top = np.argpartition(-value, k - 1, axis=1)[:, :k]
    else:
        value = np.where(allowed, ~scores, MOST)
        top = np.argsort(value, axis=1, kind="stable")[:, :k]
    return top, np.take_along_axis(allowed, top, 1)


def _scan(space: Space, shared):
    exact = space.exact_float()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Block = shared.value
        m, slots = a.lo.shape
        x = a.vectors.astype(np.float64 if exact else np.int64)
        score, ids = np.full((m, slots, a.k), LEAST), np.full((m, slots, a.k), MOST)
        for b in batches:
            for s in b.to_pylist():
                far = a.far[:, s["pivot"]]
                due = np.flatnonzero(_meets(far, a.new, s["lo"], s["hi"], space.slack) & ~_meets(far, a.old, s["lo"], s["hi"], space.slack))
                if not len(due):
                    continue
                uid, vec_id, label = (np.frombuffer(s[c], np.int64) for c in ("uids", "ids", "labels"))
                rows = np.frombuffer(s["vectors"], space.kind).reshape(s["rows"], space.dims).astype(x.dtype)
                for at in range(0, len(due), KERNEL_ROWS):
                    i = due[at : at + KERNEL_ROWS]
                    got = x[i] @ rows.T
                    fits = (a.labels[i][:, None] == label) == a.same
                    if a.same:
                        fits &= a.uids[i][:, None] != uid
                    for j in range(slots):
                        allowed = fits & (got >= a.lo[i, j][:, None]) & (got <= a.hi[i, j][:, None])
                        some = np.flatnonzero((allowed & (got >= score[i, j, -1][:, None])).any(1))
                        if not len(some):
                            continue
                        top, real = _best(got[some], allowed[some], a.k, exact)
                        new = np.where(real, np.take_along_axis(got[some], top, 1), LEAST).astype(np.int64)
                        new_id = np.where(real, vec_id[top], MOST)
                        both, both_id = np.hstack([score[i[some], j], new]), np.hstack([ids[i[some], j], new_id])
                        order = np.lexsort((both_id, ~both), axis=-1)[:, : a.k]
                        score[i[some], j], ids[i[some], j] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)
        i, j, r = np.nonzero(score > LEAST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.uids[i]), pa.array(a.ids[i]), pa.array(j.astype(np.int32)), pa.array(ids[i, j, r]), pa.array(score[i, j, r])], [c.split()[0] for c in FOUND.split(", ")]
        )

    return run


class Index:
    """Vectors (vec_id, label, v) as sorted segments."""

    def __init__(self, work: Workspace, vectors: DataFrame):
        self.work = work
        self.space, labels, sample = space_of(vectors)
        self.sample_labels, self.sample = labels[:SEEN_ROWS], sample[:SEEN_ROWS]
        keyed = vectors.withColumn("uid", F.monotonically_increasing_id())
        schema = "vec_id long, label long, v array<long>, uid long, pivot int, key double"
        self.keyed = work.store(keyed.select("vec_id", "label", "v", "uid").mapInArrow(_keyed(self.space), schema), "keyed")
        order = ["pivot", "key", "vec_id", "uid"]
        self.segments = work.store(self.keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(self.space), SEGMENT), "segments")

    def blocks(self, chosen: Column) -> Iterator[tuple]:
        """uids, ids, labels and vectors of the chosen rows, in blocks of at most BLOCK_BYTES, near ones together."""
        each = max(1, BLOCK_BYTES // (8 * max(1, self.space.dims)))
        rows = self.work.store(placed(self.work, self.keyed.where(chosen), ["pivot", "key", "uid"], "anchors").withColumn("block", F.floor(F.col("place") / each)), "anchor-blocks")
        n = rows.agg(F.max("block")).first()[0]
        for i in range(0 if n is None else n + 1):
            t = rows.where(F.col("block") == i).orderBy("place").select("uid", "vec_id", "label", "v").toArrow().combine_chunks()
            yield (*[t[c].to_numpy() for c in ("uid", "vec_id", "label")], matrix(t["v"].chunk(0), self.space.dims))

    def _radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from anchors (of such squares of lengths) at which a vector has that score."""
        return np.sqrt(np.maximum(square + self.space.most - 2 * score, 0))

    def search(self, anchors: tuple, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> DataFrame:
        """FOUND and rank: for each anchor and slot the first k rows by score, then id, with lo <= score <= hi and the anchor's
        label or another one; lo = MOST: the slot is empty; lo = LEAST and hi = MOST: without bounds."""
        uids, ids, labels, vectors = anchors
        x = vectors.astype(np.float64)
        square, far = (x * x).sum(1), self.space.to_pivots(self.space.of_anchors(vectors))
        m, slots = lo.shape
        empty, slack = lo == MOST, self.space.slack
        cap = self._radius(square, np.where(empty, np.inf, np.where(lo == LEAST, -np.inf, lo)).min(1)) * (1 + 4 * SLACK) + 4 * slack  # beyond it nothing is sought
        inner = self._radius(square, np.where(empty | (hi == MOST), np.inf, hi).min(1))
        seen = self._radius(square[:, None], x @ self.sample.T.astype(np.float64))  # of the sample
        fit = (labels[:, None] == self.sample_labels) == same
        if same:
            fit &= seen > 0
        seen = np.sort(np.where(fit & (seen >= inner[:, None]), seen, np.inf), axis=1)
        new = np.minimum(seen[:, min(1, seen.shape[1] - 1)] if seen.size else np.full(m, np.inf), cap)
        median = np.sort(np.where(np.isinf(seen), 0, seen), axis=1)[:, seen.shape[1] // 2] if seen.size else np.zeros(m)
        old, active, best, n_round = np.full(m, -1.0), ~empty.all(1), None, 0
        while active.any():
            i = np.flatnonzero(active)
            block = Block(uids[i], ids[i], labels[i], vectors[i], far[i], old[i], new[i], lo[i], hi[i], same, k)
            shared = self.work.spark.sparkContext.broadcast(block)
            wide = new[i] * (1 + SLACK) + slack
            spans = [(p, float((far[i, p] - wide).min()), float((far[i, p] + wide).max())) for p in range(far.shape[1])]
            reach = F.broadcast(self.work.spark.createDataFrame(spans, "pivot int, from_key double, to_key double"))  # a row for each pivot
            near = self.segments.join(reach, "pivot").where("hi >= from_key AND lo <= to_key").drop("from_key", "to_key")
            found = near.mapInArrow(_scan(self.space, shared), FOUND)
            found = found if best is None else found.unionByName(best.select(*found.columns))
            order = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "id")
            best = self.work.store(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
            shared.destroy()
            state = best.groupBy("uid", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).toArrow()
            n, least = np.zeros((m, slots), np.int64), np.full((m, slots), np.inf)
            order_of = np.argsort(uids)
            row = order_of[np.searchsorted(uids[order_of], state["uid"].to_numpy())]
            slot = state["slot"].to_numpy()
            n[row, slot], least[row, slot] = state["n"].to_numpy(), state["least"].to_numpy()
            full = n == k
            # What was not read is farther away than the radius.
            sure = np.maximum(new * (1 - SLACK) - slack, 0)
            bound = ((square + self.space.most - sure**2) / 2)[:, None]
            done = empty | (full & (least >= bound)) | (lo > bound) | np.isinf(new)[:, None]
            active &= ~done.all(1)
            # Where all slots are full, the distance of their last rows is sure to do; else farther out, at last everything.
            certain = np.where(full & ~done, self._radius(square[:, None], np.where(full, least, 0)), 0).max(1) * (1 + 4 * SLACK) + 4 * slack
            farther = np.maximum(median, 1.25 * new) if n_round < 2 else np.full(m, np.inf)
            n_round += 1
            wider = np.where((full | done).all(1), certain, farther) if n_round < 4 else np.full(m, np.inf)
            old, new = np.where(active, new, old), np.where(active, np.maximum(np.minimum(wider, cap), new), new)
        return best


def hard_negatives(vectors: DataFrame, chosen: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of vectors (vec_id, label, v; v: longs).

    chosen: which rows are anchors. An anchor's positives are its first `positives` other rows of its label, by score (the inner
    product) and then by smaller id; for each, the first `negatives` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score. Fewer are given where there are no more; a positive without a
    negative has no rows. Rows that share an id are rows each; a shorter vector is filled with zeros. Null ids,
    labels or vectors are not allowed here (whole_numbers() leaves them out). No rows give no rows; other columns go.
    """
    with Workspace(vectors.sparkSession, "negatives") as work:
        index = Index(work, work.store(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "v"), "vectors"))
        out = []
        for block in index.blocks(chosen):
            uids, m = block[0], len(block[0])
            best = index.search(block, np.full((m, 1), LEAST), np.full((m, 1), MOST), True, positives)
            got = best.select("uid", "rank", "score").toArrow()  # at most `positives` for each anchor of the block
            order = np.argsort(uids)
            row, at, score = order[np.searchsorted(uids[order], got["uid"].to_numpy())], got["rank"].to_numpy() - 1, got["score"].to_numpy()
            lo, hi = np.full((m, positives), MOST), np.full((m, positives), LEAST)
            # Whole numbers: 100 * negative >= low * positive, and <= high * positive.
            lo[row, at], hi[row, at] = -((-low * score) // 100), high * score // 100
            lo = np.where(lo > hi, MOST, lo)
            if (lo == MOST).all():
                continue
            found = index.search(block, lo, hi, False, negatives)
            pos = best.select("uid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            out.append(found.join(pos, ["uid", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        if not out:
            return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        every = out[0]
        for o in out[1:]:
            every = every.unionByName(o)
        return keep(every, "hard-negatives")
