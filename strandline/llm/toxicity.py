"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

A document is toxic if any sentence is: 1 - prod(1 - p_s), p_s a logistic model over the hashed words of
sentence s and their beginnings (PREFIXES bytes, for endings and compounds). Only document labels are known;
the gradient of the noisy-or's likelihood shares a label out over sentences. The model is fitted on a bounded
number of labelled rows, taken whole; every whole text is scored, and all its offending sentences are given
with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import extended, packed, prepare, row_blocks, text_buffer
from strandline.llm.wordhash import SPACE, TO_LOWER, U64, span_hashes, word_spans

#: Hash buckets of words, and the bound of the sample (rows of each label, whole texts).
BITS, SAMPLE_ROWS = 18, 2_000
#: From which probability a sentence is an offending one.
OFFENDING = 0.5
PREFIXES = (5, 6, 7, 8)
#: Bytes that end a sentence.
ENDS = b".!?\n"
PRIOR = -6.0

_STRIP = SPACE.copy()
_STRIP[:] = True  # words are runs of ASCII letters and bytes outside ASCII
_STRIP[97:123] = False
_STRIP[128:] = False
_END = np.zeros(256, bool)
_END[list(ENDS)] = True


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, bucket) pairs of all rows: sentence numbers and buckets; each sentence's row, and where (in
    bytes) its first word begins and its last one ends. What has no word is no sentence."""
    low = TO_LOWER[data]
    starts, ends, rows = word_spans(low, offsets, _STRIP)
    stops = np.cumsum(_END[low])
    part = stops[starts] if len(starts) else starts
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    new = np.ones(len(starts), bool)
    if len(starts):
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    sent = (np.cumsum(new) - 1).astype(np.int32)
    hashes, sents = [span_hashes(low, starts, ends)], [sent]
    for k in PREFIXES:
        long = ends - starts >= k
        hashes.append(span_hashes(low, starts[long], starts[long] + k) ^ U64(0x5BD1E995 * k))
        sents.append(sent[long])
    with np.errstate(over="ignore"):
        bucket = (np.concatenate(hashes) * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)).astype(np.int32)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)[: int(new.sum())]
    return np.concatenate(sents), bucket, row[new], starts[new], ends[last]


class Model:
    """Weights of the buckets and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentences(self, sent: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(sent, self.weights[bucket], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def rows(self, p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences of each of n rows; 0 without sentences."""
        return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def fit_arrays(sent: np.ndarray, bucket: np.ndarray, row: np.ndarray, labels: np.ndarray, epochs: int = 150, rate: float = 0.5, l1: float = 1e-4) -> Model:
    """Full-batch AdaGrad on the noisy-or likelihood, both labels weighted alike; L1 keeps few buckets."""
    used, bucket = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(used)), PRIOR
    gw, gb = np.full(len(used), 1e-6), 1e-6
    for _ in range(epochs):
        dz = gradient(Model(w, b), sent, bucket, row, labels)
        g = np.bincount(bucket, dz[sent], len(used))
        gw += g * g
        step = rate / np.sqrt(gw)
        w = w + step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        d = dz.sum()
        gb += d * d
        b += 0.1 * d / np.sqrt(gb)
    whole = np.zeros(1 << BITS)
    whole[used] = w
    return Model(whole, b)


def gradient(model: Model, sent: np.ndarray, bucket: np.ndarray, row: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """d log-likelihood / dz_s of the noisy-or for each sentence, both labels with half of the weight:
    p_s (1 - P) / P in a toxic row, -p_s otherwise."""
    n, positive = len(labels), labels.sum()
    p = model.sentences(sent, bucket, len(row))
    doc = model.rows(p, row, n)
    share = np.where(labels == 1, 0.5 / max(1, positive), 0.5 / max(1, n - positive))
    return (np.where(labels == 1, (1 - doc) / np.maximum(doc, 1e-9), -1.0) * share)[row] * p


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1) of the documents that may be learned from.

    Takes the rows of each label with the smallest id hashes, whole, so only their texts move; each text once
    for a label. Null texts, ids and labels are left out; an id with several texts gives each. Ties of hashes go
    by id. Without rows: a model that calls nothing toxic.
    """
    spark = prepare(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros(1 << BITS), PRIOR)
    wanted = 2 * rows  # some are copies
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * wanted / n))])
    few = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20) < share[F.col("toxic")])
    rank = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = few.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= wanted).collect()
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"], r["_r"]) for r in picked], "doc_id long, toxic int, _r int")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["text", "toxic"])
    again = F.row_number().over(Window.partitionBy("toxic").orderBy("_r", "text"))
    sample = texts.withColumn("_r", again).where(F.col("_r") <= rows).orderBy("toxic", "_r").select("text", "toxic").collect()
    if not sample:
        return Model(np.zeros(1 << BITS), PRIOR)
    data, off = text_buffer(pa.array([r["text"] for r in sample], pa.large_string()))
    sents, buckets, rows_of, so_far = [], [], [], 0
    for lo, hi in row_blocks(off):
        s, bucket, row, _, _ = sentence_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        sents.append(s + so_far), buckets.append(bucket), rows_of.append(row + lo)
        so_far += len(row)
    return fit_arrays(np.concatenate(sents), np.concatenate(buckets), np.concatenate(rows_of), np.array([r["toxic"] for r in sample], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) plus toxic_score (0 to 1) and offending: all sentences from OFFENDING on, each with its
    start, end (code points, from its first word to its last) and score; in a document that is toxic (0.5 or more)
    at least its likeliest one, of equal ones the first.

    A null text is empty; texts without words score 0. Repeated rows have equal results, no rows give none. Other
    columns stay, but for those with the name of a result.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    docs = docs.drop("toxic_score", "offending")
    rows, unpack = packed(docs, "text")
    item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                own, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                sent, bucket, row, begin, end = sentence_words(own, at)
                p = m.sentences(sent, bucket, len(row))
                doc = m.rows(p, row, hi - lo)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for r in np.flatnonzero(doc >= 0.5).tolist():
                    a, b = first[r], first[r + 1]
                    point = np.cumsum((own[at[r] : at[r + 1]] & 0xC0) != 0x80)  # code points up to each byte
                    for s in (np.flatnonzero(p[a:b] >= min(OFFENDING, p[a:b].max())) + a).tolist():
                        found[r].append({"start": int(point[begin[s] - at[r]]) - 1, "end": int(point[end[s] - 1 - at[r]]), "score": float(p[s])})
                    if p[a:b].max() < OFFENDING:
                        found[r] = found[r][:1]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.clip(doc, 0, 1)), pa.array(found, item)], [*batch.schema.names, "toxic_score", "offending"])

    out = rows.mapInArrow(kernel, extended(rows, "toxic_score double, offending array<struct<start:int, end:int, score:double>>"))
    return out.select(*unpack(out), "toxic_score", "offending")
