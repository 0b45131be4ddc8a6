"""A hashed maximum-entropy language model with class-factored softmax, in three factors.

    P(token | history) = P(group | history) * P(class | group, history) * P(word | class, history)

Each factor is a softmax over at most 32 or 16 outcomes, a maximum-entropy model over the same hashed features
of the history: the token before (n-gram), the one before that (skip), both together (n-gram), the classes of the
two, and those of the third and fourth before (skip). A token costs three small softmaxes, though there are hundreds of
classes and any number of words.

The FREQUENT most frequent words are clustered by the company they keep into 15 groups of up to 16 classes of up to 16 words.
Every other word's class is the frequent words' class that it follows most (240 classes of such rarer words, in 15 more
groups); there the word factor is the word's share of its class, which is the maximum-entropy solution
without features. The end of a text and all words that training never saw are outcomes of the first factor.

1. The frequent words and their neighbours are counted over all training texts; only these words and the table of
   their pairs reach the driver.
2. All training texts are counted: each token, by the class of the frequent word before it. Sums over tasks give exact counts.
3. ROUNDS synchronous updates, each over its own part of the training texts, dealt by a fixed hash of the row: every
   task sums up how often each feature met each outcome and how often the model expected that, the sums of all
   tasks are added piece by piece, and one generalised iterative scaling step follows. Results don't depend on how rows lie in partitions.
   The number of hash buckets follows the number of training tokens up to what a task can hold (BITS).
4. Texts are scored in sparse numpy batches.

The head of the vocabulary (at most HEAD tokens) is broadcast; classes and counts of the other tokens are joined to the
texts that hold them by a shuffle. Both give the same terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, prepare, row_blocks, text_buffer
from strandline.llm.wordhash import SPACE, TO_LOWER, U64, mapped, mix, span_hashes, word_spans

#: Groups of frequent words (as many of rarer ones), classes of a group, words of a frequent class.
GROUPS, SUB, WORDS = 15, 16, 16
END_OUT, OTHER_OUT, OUT = 2 * GROUPS, 2 * GROUPS + 1, 2 * GROUPS + 2
#: Classes: of frequent words, of rarer ones, the end, the unseen ones; START stands before a text.
FINE = GROUPS * SUB
END_CLASS, OTHER_CLASS, START = 2 * FINE, 2 * FINE + 1, 2 * FINE + 2
CLASSES = 2 * FINE + 2
#: Most tokens whose counts are broadcast; most counts a task holds before it passes them on.
HEAD, HELD = 1_000_000, 400_000
#: How many of the most frequent words are clustered by their neighbours; the others' classes follow from them.
FREQUENT = 1_024
#: Updates, the counts added to both sides of a step's ratio, and its length.
ROUNDS, SMOOTH, STEP = 6, 4.0, 2.0
#: Tokens in a numpy batch, and tokens whose expectations are summed up at once.
BATCH, TOGETHER = 4_096, 65_536
FEATURES = 5
#: Most of a sum of weights, and least of one whose exponential is a product of exponentials in single precision.
MOST, LEAST = 60, -80
#: Least and most bits of the features' hashes: at 17 the weights are 50 MB, and a task's sums 200 MB.
BITS = (13, 17)
#: The end's place among 64-bit token hashes.
END = U64(0xE5D0F7E57E5D0F7E)
#: What travels with a text: its known tokens outside the head.
TAIL = "array<struct<token:bigint,n:bigint,class:smallint>>"
_PIECE = 256  # rows of sums that travel together


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row's words and then its end, and where each row begins (rows + 1)."""
    low = mapped(data, TO_LOWER)
    starts, ends, rows = word_spans(low, offsets, SPACE)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, U64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))] = span_hashes(low, starts, ends)
    at = rows + np.arange(n + 1)
    out[at[1:] - 1] = END
    return out, at


class Lookup:
    """Places of 64-bit keys in a sorted array, by an index over their upper bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length())
        edges = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U64) << U64(64 - self.bits))
        self.start = np.append(edges, len(keys)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        top = (x >> U64(64 - self.bits)).astype(np.int64)
        lo, hi = self.start[top], self.start[top + 1]
        out = np.full(len(x), -1, np.int64)
        left = np.flatnonzero(lo < hi)
        for i in range(self.most):
            at = lo[left] + i
            hit = self.keys[at] == x[left]
            out[left[hit]] = at[hit]
            left = left[~hit & (at + 1 < hi[left])]
            if not len(left):
                break
        return out


@dataclass
class Vocabulary:
    """The head: sorted keys, classes, words' numbers in their class, counts; and of the whole vocabulary: counts by
    class and by word of a frequent class, tokens, types and types seen once."""

    keys: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    word_sums: np.ndarray
    n_tokens: int
    n_types: int
    n_once: int

    @property
    def base_log(self) -> float:
        return float(np.log10(self.n_tokens + self.n_types + 1))

    def look_up(self, find: Lookup, tok: np.ndarray, tails: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, words' numbers and counts of tokens, by the head and by what came with their texts; OTHER_CLASS and 0 of those never seen."""
        place = find(tok)
        cls, n, word = np.full(len(tok), OTHER_CLASS, np.int64), np.zeros(len(tok), np.int64), np.zeros(len(tok), np.int64)
        at = np.flatnonzero(place >= 0)
        cls[at], word[at], n[at] = self.classes[place[at]], self.words[place[at]], self.counts[place[at]]
        keys, counts, classes = (x.to_numpy(zero_copy_only=False) for x in tails.flatten().flatten())
        if len(keys):
            keys, first = np.unique(keys.view(U64), return_index=True)
            rest = np.flatnonzero(place < 0)
            at = np.searchsorted(keys, tok[rest]).clip(0, len(keys) - 1)
            ok = keys[at] == tok[rest]
            cls[rest[ok]], n[rest[ok]] = classes[first[at[ok]]], counts[first[at[ok]]]
        return cls, word, n

    def bits(self) -> int:
        """Bits of the features' hashes: one bucket for some thousands of training tokens."""
        return int(np.clip(self.n_tokens.bit_length() - 13, *BITS))

    def biases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log masses of the outcomes of each factor; unseen words have the mass of those seen once (at least one)."""
        mass = self.sums.astype(float).copy()
        mass[OTHER_CLASS] = max(1, self.n_once)
        fine = mass[: 2 * FINE].reshape(2 * GROUPS, SUB)
        one = np.append(fine.sum(1), mass[2 * FINE :])
        tiny = 1e-9
        return tuple(np.log(x + tiny).astype(np.float32) for x in (one, fine, self.word_sums.reshape(FINE, WORDS)))


def frequent_tokens(training: DataFrame) -> np.ndarray:
    """Hashes of the FREQUENT most frequent tokens of all training texts, the most frequent first (the end among them)."""
    none = np.zeros(0, np.int64)
    rows = token_parts(training, Frequent(none.view(U64), none, none)).repartition("token").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r["token"] for r in rows], np.int64).view(U64)


@dataclass
class Frequent:
    """Sorted hashes of the frequent words, their classes (0 to FINE - 1) and numbers in their class."""

    keys: np.ndarray
    classes: np.ndarray
    words: np.ndarray


def neighbours(training: DataFrame, top: np.ndarray) -> np.ndarray:
    """For each two frequent tokens, over all training texts, how often the second follows: 1 each next to it, 1/2 and 1/3 further on."""
    shared = training.sparkSession.sparkContext.broadcast(top)
    k = len(top)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value)
        m = np.zeros(k * k, np.int64)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                tok, at = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                place, row = find(tok), np.repeat(np.arange(hi - lo), np.diff(at))
                for d in (1, 2, 3):
                    ok = np.flatnonzero((place[:-d] >= 0) & (place[d:] >= 0) & (row[:-d] == row[d:]))
                    np.add.at(m, place[ok] * k + place[ok + d], 6 // d)
        pair = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(m[pair])], ["pair", "n"])

    out = np.zeros(k * k)
    t = training.select("text").mapInArrow(kernel, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # FREQUENT x FREQUENT rows at most
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy() / 6
    return out.reshape(k, k)


def capped_groups(points: np.ndarray, k: int, cap: int) -> np.ndarray:
    """Spherical k-means with at most `cap` points in a group; points come in order of importance, and each takes the
    nearest centre that has room."""
    if len(points) == 0:
        return np.zeros(0, np.int64)
    centres = points[np.random.default_rng(5).permutation(len(points))[:k]].copy()
    for _ in range(30):
        group = np.argmax(points @ centres.T, axis=1)
        for g in range(len(centres)):
            if (group == g).any():
                c = points[group == g].sum(0)
                centres[g] = c / (np.linalg.norm(c) + 1e-9)
    if len(points) > cap * len(centres):
        raise ValueError("more points than room")
    out, room = np.zeros(len(points), np.int64), np.full(len(centres), cap)
    for i, order in enumerate(np.argsort(-(points @ centres.T), axis=1, kind="stable")):
        out[i] = order[np.flatnonzero(room[order] > 0)[0]]
        room[out[i]] -= 1
    return out


def frequent_words(training: DataFrame) -> Frequent:
    """The most frequent words of all training texts with their classes by the company they keep."""
    ranked = frequent_tokens(training)
    ranked = ranked[ranked != END]
    none = np.zeros(0, np.int64)
    if not len(ranked):
        return Frequent(np.zeros(0, U64), none, none)
    order = np.argsort(ranked)
    top, rank = ranked[order], np.argsort(order)  # rank[i]: where the i-th most frequent is in top
    m = neighbours(training, top)
    m = m + m.T + 0.1
    values, vectors = np.linalg.eigh(np.maximum(np.log(m * m.sum() / np.outer(m.sum(1), m.sum(1))), 0))
    k = min(24, len(top))
    points = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:], 0))
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-9
    points = points[rank]
    group = capped_groups(points, GROUPS, SUB * WORDS)
    cls, word = np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
    for g in range(GROUPS):
        own = np.flatnonzero(group == g)
        cls[own] = g * SUB + capped_groups(points[own], SUB, WORDS)
    for c in np.unique(cls):
        word[cls == c] = np.arange((cls == c).sum())
    return Frequent(top, cls[order], word[order])


def summed(keys: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts over equal (key, group), groups under 2^9."""
    if not len(keys):
        return keys, groups, counts
    if not groups.any():  # keys alone are sorted
        if (counts == 1).all():
            types, n = np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            types, n = keys[first], np.add.reduceat(counts[order], first)
        return types, np.zeros(len(types), np.int64), n
    types, back = np.unique(keys, return_inverse=True)
    pair = (back.astype(np.int64) << 9) + groups
    if (counts == 1).all():
        pair = np.sort(pair)
    else:
        order = np.argsort(pair)
        pair, counts = pair[order], counts[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return types[pair[first] >> 9], pair[first] & 511, np.add.reduceat(counts, first)


def token_parts(training: DataFrame, frequent: Frequent) -> DataFrame:
    """token (hash), g, n: the tasks' counts of each token by the class of the frequent word before it.

    Where no frequent word is before it, as in a rare language, the token just before decides by its hash.
    """
    shared = training.sparkSession.sparkContext.broadcast(frequent)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, group = shared.value.keys, shared.value.classes
        find = Lookup(top)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return summed(*(np.concatenate([h[i] for h in held]) for i in range(3)))

        def sent(keys: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(groups.astype(np.int16)), pa.array(counts)], ["token", "g", "n"])

        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                tok, at = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                own = np.zeros(len(tok), np.int64)
                if len(top):
                    place, first = find(tok), np.repeat(at[:-1], np.diff(at))
                    known = np.where(place >= 0, np.arange(len(tok)), -1)
                    before = np.append(-1, np.maximum.accumulate(known)[:-1])
                    last = np.where(np.arange(len(tok)) > first, np.append(U64(0), tok[:-1]) % U64(FINE), 0).astype(np.int64)
                    own = np.where(place >= 0, group[place], np.where(before >= first, group[place[before]], last))
                held.append(summed(tok, own, np.ones(len(tok), np.int64)))
                if sum(len(h[0]) for h in held) > 2 * HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    return training.select("text").mapInArrow(kernel, "token long, g short, n long")


def count_tokens(training: DataFrame, frequent: Frequent) -> DataFrame:
    """token (hash), n, class: exact counts over all training texts; a frequent word's own class, else the class that the token follows most."""
    # The tasks have summed up what they hold: what they send is dealt once, by token, and both sums are made where it arrives.
    parts = token_parts(training, frequent).repartition("token").groupBy("token", "g").agg(F.sum("n").alias("n"))
    most = parts.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("g")).alias("g")))["g"].alias("g"))
    own = F.col("token").isin(frequent.keys.view(np.int64).tolist()) if len(frequent.keys) else F.lit(False)
    cls = F.when(F.col("token") == int(END.view(np.int64)), END_CLASS).when(own, -F.col("g")).otherwise(FINE - F.col("g"))
    return most.select("token", "n", cls.cast("short").alias("class"))


def vocabulary(counts: DataFrame, frequent: Frequent) -> tuple[Vocabulary, int]:
    """The head of stored counts (all frequent words, and tokens with at least a count), and that count."""
    by_n = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # as many rows as distinct counts
    least, held = 1, 0
    for n, k in by_n:
        if held + k > HEAD:
            least = n + 1
            break
        held += k
    sums = np.zeros(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        sums[r["class"]] = r["n"]
    always = F.col("token").isin(frequent.keys.view(np.int64).tolist()) if len(frequent.keys) else F.lit(False)
    t = counts.where((F.col("n") >= least) | always).toArrow()
    keys = t.column("token").to_numpy().view(U64)
    order = np.argsort(keys)
    keys, n, cls = keys[order], t.column("n").to_numpy()[order], t.column("class").to_numpy()[order].astype(np.int16)
    words, word_sums = np.zeros(len(keys), np.int16), np.zeros(FINE * WORDS)
    if len(frequent.keys) and len(keys):
        at = np.searchsorted(keys, frequent.keys).clip(0, len(keys) - 1)
        ok = keys[at] == frequent.keys
        words[at[ok]] = frequent.words[ok]
        word_sums[frequent.classes[ok] * WORDS + frequent.words[ok]] = n[at[ok]]
    return Vocabulary(keys, cls, words, n, sums, word_sums, sum(n * k for n, k in by_n), sum(k for _, k in by_n), sum(k for n, k in by_n if n == 1)), least


def with_tails(work: Workspace, rows: DataFrame, counts: DataFrame, vocab, least: int) -> DataFrame:
    """rows (doc_id, text, held_out) with tail: count and class of each text's known tokens outside the head."""
    if vocab.value.n_types == len(vocab.value.keys):
        return rows.withColumn("tail", F.lit(None).cast(TAIL))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(vocab.value.keys)
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                tok, at = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                rare = np.flatnonzero(find(tok) < 0)
                tok, row = tok[rare], np.repeat(np.arange(hi - lo), np.diff(at))[rare]
                order = np.lexsort((tok, row))
                tok, row = tok[order], row[order]
                new = np.append(True, (tok[1:] != tok[:-1]) | (row[1:] != row[:-1]))[: len(tok)]
                ends = np.append(0, np.cumsum(np.bincount(row[new], minlength=hi - lo))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(tok[new].view(np.int64)))], ["doc_id", "text", "held_out", "rare"])

    found = rows.mapInArrow(kernel, "doc_id long, text string, held_out boolean, rare array<long>")
    stored = work.store(found.withColumn("_row", F.monotonically_increasing_id()), "texts")
    known = stored.select("_row", F.explode("rare").alias("token")).join(counts.where(F.col("n") < least), "token")
    tails = known.groupBy("_row").agg(F.collect_list(F.struct("token", "n", "class")).alias("tail"))
    out = work.store(stored.drop("rare").join(tails, "_row", "left").select("doc_id", "text", "held_out", F.col("tail").cast(TAIL).alias("tail")), "tails")
    work.drop(stored)
    return out


def features(tok: np.ndarray, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """64-bit hashes of each token's history (FEATURES x n): the token before, the one before that, both, the classes of the two,
    and the classes of the third and fourth before."""
    n = len(tok)
    pos = np.arange(n) - np.repeat(at[:-1], np.diff(at))

    def back(x: np.ndarray, d: int, start: int) -> np.ndarray:
        out = np.full(n, start, x.dtype)
        out[d:] = x[:-d] if n > d else x[:0]
        out[pos < d] = start
        return out

    h1, h2 = back(tok, 1, 1), back(tok, 2, 2)
    c = [back(cls, d, START).astype(U64) for d in (1, 2, 3, 4)]
    out = np.empty((FEATURES, n), U64)
    with np.errstate(over="ignore"):
        k = U64(0x9E3779B97F4A7C15)
        for j, x in enumerate((h1, h2 + k, h1 * k + h2, c[0] * U64(1 << 12) + c[1], c[2] * U64(1 << 12) + c[3])):
            out[j] = mix(x * k + U64(j))
    return out


class Layout:
    """Where the weights of the factors are: rows of 16 columns; the first factor has two rows for each bucket."""

    def __init__(self, bits: int):
        self.bits = (bits, bits + 1, bits + 1)
        self.wide = (OUT, SUB, WORDS)
        self.bias = 0, OUT // 16, OUT // 16 + 2 * GROUPS  # rows of the outcomes' own weights, by condition
        first = OUT // 16 + 2 * GROUPS + FINE
        self.begin = first, first + (OUT // 16 << bits), first + (OUT // 16 << bits) + (2 << bits)
        self.rows = self.begin[2] + (2 << bits)

    def table(self, w: np.ndarray, factor: int) -> np.ndarray:
        """The hashed rows of one factor."""
        end = self.begin[factor + 1] if factor < 2 else self.rows
        return w[self.begin[factor] : end].reshape(-1, self.wide[factor])

    def own(self, w: np.ndarray, factor: int) -> np.ndarray:
        """The outcomes' own weights for each condition of one factor."""
        end = self.bias[factor + 1] if factor < 2 else self.begin[0]
        return w[self.bias[factor] : end].reshape(-1, self.wide[factor])

    def buckets(self, h: np.ndarray, condition: np.ndarray, factor: int) -> np.ndarray:
        """Rows of table() for feature hashes (FEATURES x n) and a condition (the group, the class)."""
        with np.errstate(over="ignore"):
            x = h ^ (condition.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            x *= U64(0x9E3779B97F4A7C15 | 1)
            x >>= U64(64 - self.bits[factor])
        return x.view(np.int64)


def by_class(cls: np.ndarray) -> np.ndarray:
    """An order of the tokens by class: those of each factor come first, and those of a condition together."""
    return np.argsort(cls.astype(np.uint16), kind="stable")


def factors(cls: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each factor the condition and the outcome of the tokens that have it, the first ones of tokens in order of class."""
    two, three = np.searchsorted(cls, [2 * FINE, FINE])
    one = np.minimum(cls // SUB, END_OUT) + (cls == OTHER_CLASS)
    return [(np.zeros(len(cls), np.int64), one), (one[:two], cls[:two] % SUB), (cls[:three], word[:three])]


class Scorer:
    """The three softmaxes with weights w (rows x 16) and log masses of the outcomes; works in buffers of BATCH tokens.

    Factors whose weights cannot leave the range of single precision hold their exponentials, which are multiplied; the others
    add up weights and take the exponential of each sum. Both give the same masses.
    """

    def __init__(self, lay: Layout, w: np.ndarray, bias: tuple):
        self.lay = lay
        self.tables = [np.ascontiguousarray(lay.table(w, k)) for k in range(3)]
        self.own = []
        for k in range(3):
            masses = bias[k].reshape(-1, lay.wide[k]).astype(float)
            top = masses.max(axis=1, keepdims=True)
            masses -= top + np.log(np.exp(masses - top).sum(axis=1, keepdims=True))  # so that logits stay small
            self.own.append((lay.own(w, k) + masses).astype(np.float32))
        self.product = []
        for k, (t, own) in enumerate(zip(self.tables, self.own, strict=True)):
            self.product.append(bool(own.max() + FEATURES * max(t.max(), 0) <= MOST and own.min() + FEATURES * min(t.min(), 0) >= LEAST))
            if self.product[k]:
                self.tables[k], self.own[k] = np.exp(t), np.exp(own)
        self.buffers = [[np.empty((BATCH, n), np.float32) for _ in range(2)] for n in lay.wide]

    def masses(self, factor: int, rows: np.ndarray, condition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x outcomes of at most BATCH tokens, in a buffer that the next call uses again, and their sums; a share of its sum is a probability."""
        z, one = (b[: len(condition)] for b in self.buffers[factor])
        join = np.multiply if self.product[factor] else np.add
        np.take(self.own[factor], condition, axis=0, out=z, mode="clip")
        for r in rows:
            np.take(self.tables[factor], r, axis=0, out=one, mode="clip")
            join(z, one, out=z)
        if not self.product[factor]:
            np.exp(np.minimum(z, MOST, out=z), out=z)
        return z, np.einsum("ij->i", z)  # z.sum(axis=1) takes a loop of its own for each row

    def probabilities(self, factor: int, rows: np.ndarray, condition: np.ndarray) -> np.ndarray:
        z, all_of = self.masses(factor, rows, condition)
        return z / all_of[:, None]


class Sums:
    """How often each feature met each outcome (seen), and how often the model expected it to."""

    def __init__(self, lay: Layout):
        self.lay = lay
        self.seen = np.zeros((lay.rows, 16))
        self.cells: list[np.ndarray] = []
        n_rows = [(lay.table(self.seen, k).shape[0], lay.own(self.seen, k).shape[0]) for k in range(3)]
        # Outcomes x rows, in doubles; two outcomes are a complex number, as it takes both with one access.
        self.sums = [[np.zeros((w // 2, n), complex) for n in both] for w, both in zip(lay.wide, n_rows, strict=True)]
        self.held = [np.empty((w // 2, TOGETHER), complex) for w in lay.wide]

    def add(self, model: Scorer, h: np.ndarray, cls: np.ndarray, word: np.ndarray) -> None:
        """Adds at most TOGETHER tokens: probabilities are summed up by bucket for one outcome after another."""
        lay, order = self.lay, by_class(cls)
        h, cls, word = np.take(h, order, axis=1), cls[order], word[order]
        for factor, (condition, out) in enumerate(factors(cls, word)):
            if not len(condition):
                continue
            rows = lay.buckets(h[:, : len(condition)], condition, factor)
            held = self.held[factor][:, : len(condition)]
            for i in range(0, len(condition), BATCH):
                z, all_of = model.masses(factor, rows[:, i : i + BATCH], condition[i : i + BATCH])
                z /= all_of[:, None]
                held[:, i : i + BATCH] = z.view(np.complex64).T
            table, own = self.sums[factor]
            for p, s in zip(held, table, strict=True):
                for r in rows:
                    np.add.at(s, r, p)
            first = np.flatnonzero(np.append(True, condition[1:] != condition[:-1]))
            own[:, condition[first]] += np.add.reduceat(held, first, axis=1)
            for r, begin in [*((r, lay.begin[factor]) for r in rows), (condition, lay.bias[factor])]:
                self.cells.append(begin * 16 + r * lay.wide[factor] + out)
        if sum(map(len, self.cells)) > 1 << 20:
            self.flush()

    def flush(self) -> None:
        for c in self.cells:
            np.add.at(self.seen.reshape(-1), c, 1.0)  # touches these cells alone, where a bincount goes over all
        self.cells.clear()

    @property
    def expected(self) -> np.ndarray:
        out = np.zeros_like(self.seen)
        for k, (table, own) in enumerate(self.sums):
            self.lay.table(out, k)[:] = np.ascontiguousarray(table.T).view(float)
            self.lay.own(out, k)[:] = np.ascontiguousarray(own.T).view(float)
        return out


def step(lay: Layout, w: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One generalised iterative scaling step; unseen words' weight stays, as training has none."""
    up = np.log((seen + SMOOTH) / (expected + SMOOTH)) * (STEP / (FEATURES + 1))
    for t in (lay.table(up, 0), lay.own(up, 0)):
        t[:, OTHER_OUT] = 0
    return (w + up).astype(np.float32)


def gather(work: Workspace, part: DataFrame, tasks: int, vocab, weights, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows (text, tail) of `part`, which has at most so many tasks, piece by piece; 64 tasks' sums meet at a time."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, w = vocab.value, weights.value
        find, model, sums, any_row = Lookup(v.keys), Scorer(lay, w, v.biases()), Sums(lay), False
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                tok, at = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cls, word, _ = v.look_up(find, tok, batch.column("tail").slice(lo, hi - lo))
                h = features(tok, at, cls)
                for i in range(0, len(tok), TOGETHER):
                    sums.add(model, h[:, i : i + TOGETHER], cls[i : i + TOGETHER], word[i : i + TOGETHER])
                any_row = True
        if any_row:
            sums.flush()
            both = np.stack([sums.seen, sums.expected], axis=1).astype(np.float32)
            pieces = range(0, lay.rows, _PIECE)
            me = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([i // _PIECE for i in pieces], pa.int32()), pa.array([me] * len(pieces), pa.int32()), pa.array([both[i : i + _PIECE].tobytes() for i in pieces], pa.binary())], ["piece", "part", "blob"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sum(np.frombuffer(b, np.float32).astype(float) for b in pdf["blob"])
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "part": [pdf["part"].iloc[0]], "blob": [x.astype(np.float32).tobytes()]})

    schema = "piece int, part int, blob binary"
    now, most = part.select("text", "tail").mapInArrow(kernel, schema), tasks - 1
    if most >= 64:
        now = work.store(now, "sums")
    out = np.zeros((lay.rows, 2, 16))
    while True:
        up = now.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("piece", "part").applyInPandas(total, schema)
        most //= 64
        if most == 0:
            break
        now = work.store(up, "sums")
    for r in up.select("piece", "blob").toLocalIterator():  # one row for each piece
        x = np.frombuffer(r["blob"], np.float32).reshape(-1, 2, 16)
        out[r["piece"] * _PIECE : r["piece"] * _PIECE + len(x)] = x
    work.drop(now)
    return out[:, 0], out[:, 1]


def train(work: Workspace, training: DataFrame, vocab, lay: Layout) -> np.ndarray:
    """Weights (rows x 16) after ROUNDS synchronous updates; training: doc_id, text, tail."""
    sc = training.sparkSession.sparkContext
    w = np.zeros((lay.rows, 16), np.float32)
    tasks = max(sc.defaultParallelism, -(-training.rdd.getNumPartitions() // ROUNDS))
    deal = F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        weights = sc.broadcast(w)
        w = step(lay, w, *gather(work, training.where(deal == r).coalesce(tasks), tasks, vocab, weights, lay))
        weights.destroy()
    return w


def log_probabilities(model: Scorer, v: Vocabulary, h: np.ndarray, cls: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of each token's probability."""
    out, back = np.zeros(len(cls)), np.empty(len(cls))
    order = by_class(cls)
    h, cls, word, n = np.take(h, order, axis=1), cls[order], word[order], n[order]
    for factor, (condition, outcome) in enumerate(factors(cls, word)):
        for i in range(0, len(condition), BATCH):
            c = condition[i : i + BATCH]
            part = slice(i, i + len(c))
            z, all_of = model.masses(factor, model.lay.buckets(h[:, part], c, factor), c)
            out[part] += np.log10(z[np.arange(len(c)), outcome[part]] / all_of + 1e-30)
    rare = slice(*np.searchsorted(cls, [FINE, 2 * FINE]))
    out[rare] += np.log10(n[rare] / v.sums[cls[rare]])
    out[cls == OTHER_CLASS] -= np.log10(v.n_types + 1)  # any unseen word is as likely as another, of as many as were seen
    back[order] = out
    return back


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text).

    Learns from the rows that aren't held out. A null or empty text has one token, its end. Repeated rows
    are scored each, alike, and counted each; null ids are ids like others. Ties of counts go by the token's hash.
    Without training texts all tokens are unseen. Columns besides these two aren't read. No rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    with Workspace(spark, "lm") as work:
        training = rows.where(~F.col("held_out")).select("text")
        frequent = frequent_words(training)
        counts = work.store(count_tokens(training, frequent), "counts")
        v, least = vocabulary(counts, frequent)
        vocab = spark.sparkContext.broadcast(v)
        rows = with_tails(work, rows, counts, vocab, least)
        lay = Layout(v.bits())
        weights = spark.sparkContext.broadcast(train(work, rows.where(~F.col("held_out")), vocab, lay))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocab.value
            find, model = Lookup(v.keys), Scorer(lay, weights.value, v.biases())
            for batch in batches:
                data, off = text_buffer(batch.column("text"))
                for lo, hi in row_blocks(off):
                    tok, at = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    cls, word, count = v.look_up(find, tok, batch.column("tail").slice(lo, hi - lo))
                    lp = log_probabilities(model, v, features(tok, at, cls), cls, word, count)
                    n = np.diff(at)
                    base = np.add.reduceat(np.log10(count + 1), at[:-1]) - n * v.base_log
                    score, n_known = np.add.reduceat(lp, at[:-1]), np.add.reduceat((count > 0).astype(np.int64), at[:-1])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(n), pa.array(n_known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        scored = rows.mapInArrow(kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        return keep(scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"), "lm-scores")
