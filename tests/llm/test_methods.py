"""The methods of the operators against plain or brute-force versions of themselves."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, ctph, decontamination, idstore, langid, langmodel, neardup, privacy, sharding, toxicity, wordhash
from strandline.llm.common import Workspace, table
from strandline.llm.wordhash import span_hashes


def buffer(text):
    return np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])


# decontamination


def test_proximity_is_that_of_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(list("abcdefgh"), 60)) for i in range(12)}
    items = {1: "a b", 2: "c d e", 3: "h", 4: "f f g", 5: "zz a"}
    within = 3
    counts = Counter(w for t in texts.values() for w in t.split())
    want = set()
    for i, t in texts.items():
        w = t.split()
        for k, item in items.items():
            terms = set(item.split())
            if all(counts[x] for x in terms):
                # the rarest; of equal ones the smaller hash, which only the operator knows
                least = min(counts[x] for x in terms)
                pivots = [x for x in terms if counts[x] == least]
                assert len(pivots) == 1
                for at in (j for j, x in enumerate(w) if x == pivots[0]):
                    places = [at]
                    for x in terms - {pivots[0]}:
                        near = [(abs(j - at), j) for j, y in enumerate(w) if y == x and abs(j - at) <= within]
                        places.append(min(near)[1] if near else None)
                    if None not in places:
                        want.add((i, k, min(places), max(places) - min(places) + 1))
    got = decontamination.matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), within=within).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["length"]) for r in got} == want and len(got) == len(want) > 50


def test_both_lists_are_stored_and_joined(spark, sf):
    """The lists of the two rarest terms are posted and meet by text, term and place; a window of common words is found too."""
    d = spark.createDataFrame([(i, f"the cat sat on the mat {i} the dog") for i in range(30)], "doc_id long, text string")
    with Workspace(spark, "test") as work:
        index = decontamination.Index(work, d, spark.createDataFrame([(1, "cat sat on")], "item_id long, text string"), 10)
        lists = index.lists(index.ranked.where("rank <= 2").select("term"))
        assert lists.groupBy("term").count().collect() and lists.select("term").distinct().count() == 2 and lists.count() == 60
        assert {(r["doc_id"], r["start"]) for r in index.exact().collect()} == {(i, 1) for i in range(30)}


# personal data


def test_scans_are_linear_and_without_largest_lengths():
    texts = ["1" * 10**6, "0" * 10**6 + ".1.1.1", "1." * 10**6, "+1" + "(" * 10**6, "1 " * 10**6, "a" * 10**6 + "@", "a@" * 300_000, "(at)" * 200_000, "1.2.3.4 " * 100_000, "4111 1111 1111 1111, " * 50_000]
    begin = time.time()
    found = []
    for t in texts:
        base = privacy.base_spans(t)
        found.append((len(base), len(privacy.proposed_spans(t, base))))
    assert time.time() - begin < 20
    assert found[1] == (1, 0) and privacy.base_spans(texts[1])[0] == (1, 0, 10**6 + 6)
    assert found[8][0] == 100_000 and found[9][0] == 50_000
    long = "x" * 500 + " (at) " + ".".join(["host"] * 200) + ".com"
    assert privacy.proposed_spans(long, []) == [(0, 0, len(long))]


def test_base_spans_are_those_of_the_patterns():
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub(r"\D", "", s)
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and privacy.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    rng = np.random.default_rng(1)
    for _ in range(4000):
        t = "".join(rng.choice(list("0123456789..  --+()@ab"), rng.integers(0, 60)))
        want = [(i, m.start(), m.end()) for i, r in enumerate(rx) for m in re.finditer(r, t) if ok[i](m[0])]
        assert privacy.base_spans(t) == want
        assert not any(x < b and a < y for _, a, b in privacy.proposed_spans(t, want) for _, x, y in want)


def planted(n, seed):
    """Texts with phone numbers in national form (some with a cue before them, at a rate) and as many part numbers; truth by text."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        real = bool(i % 2)
        cue = rng.random() < (0.7 if real else 0.02)
        against = not cue and rng.random() < (0.02 if real else 0.6)
        digits = rng.integers(0, 10, 10)
        if real:
            digits[0], digits[3] = rng.integers(2, 10, 2)
            form = "({}{}{}) {}{}{}-{}{}{}{}" if rng.random() < 0.9 else "{}{}{} {}{}{} {}{}{}{}"
        else:
            form = "{}{}{}{}-{}{}{}{}{}{}" if rng.random() < 0.9 else "{}{}{} {}{}{} {}{}{}{}"
        word = "call" if cue else "part" if against else rng.choice(["blue", "green", "stone", "river"])
        rows.append((i, f"some words {word} {form.format(*digits)} and more words", real))
    return rows


def test_reliabilities_and_added_spans_of_planted_data(spark):
    rows = planted(3000, 5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    candidates = privacy.extract(docs).collect()
    pairs = Counter((s["kind"], s["votes"]) for r in candidates for s in r["spans"])
    keys = sorted(pairs)
    _, theta = privacy.reliabilities(np.array([k for k, _ in keys]), np.array([privacy.decode(v) for _, v in keys]), np.array([float(pairs[k]) for k in keys]))
    truth = {i: real for i, _, real in rows}
    cue, phone = privacy.LABELERS.index("cue"), privacy.KINDS.index("phone")
    for real in (0, 1):
        own = [privacy.decode(s["votes"])[cue] for r in candidates for s in r["spans"] if truth[r["doc_id"]] == bool(real)]
        for v in (-1, 0, 1):
            assert abs(theta[phone, real, cue, v + 1] - np.mean([x == v for x in own])) < 0.1
    added = {r["doc_id"] for r in privacy.find(docs).collect() if r["spans"]}
    real = {i for i, t in truth.items() if t}
    assert len(added & real) / len(added) > 0.9 and len(added & real) / len(real) > 0.95  # precision (0.905), recall (0.987)


def test_classifier_learns_from_words_that_no_labeler_reads():
    rng = np.random.default_rng(2)
    rows, target = [], []
    for i in range(600):
        word = "ring" if i % 2 else "lot"
        text = f"{word} {rng.integers(100, 999)}-{rng.integers(100, 999)}-{rng.integers(1000, 9999)}"
        a, b = len(word) + 1, len(text)
        v = privacy.votes(text, 3, a, b)
        rows.append(privacy.features(text, 3, a, b, v)), target.append(float(i % 2))
    model = privacy.train(rows, np.array(target))
    p = [1 / (1 + np.exp(-(model.bias + model.weights[r].sum()))) for r in rows]
    assert np.mean((np.array(p) > 0.5) == (np.array(target) > 0.5)) == 1


# toxicity


def test_noisy_or_and_its_gradient():
    rng = np.random.default_rng(0)
    sent, bucket, row, labels = rng.integers(0, 9, 40), rng.integers(0, 30, 40), np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1, 0, 1, 0])
    w, b = rng.normal(size=1 << toxicity.BITS) * 0.3, -1.0

    def likelihood(z):
        total = 0.0
        for r, y in enumerate(labels):
            p = 1 - np.prod([1 - 1 / (1 + np.exp(-z[s])) for s in range(9) if row[s] == r])
            total += (np.log(p) if y else np.log(1 - p)) * 0.5 / (labels == y).sum()
        return total

    z = np.array([b + sum(w[k] for s, k in zip(sent, bucket, strict=True) if s == i) for i in range(9)])
    model = toxicity.Model(w, b)
    p = model.sentences(sent, bucket, 9)
    assert np.allclose(p, 1 / (1 + np.exp(-z)))
    assert np.allclose(model.rows(p, row, 4), [1 - np.prod(1 - p[row == r]) for r in range(4)])
    g = toxicity.gradient(model, sent, bucket, row, labels)
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-6
        assert g[i] == pytest.approx((likelihood(z + e) - likelihood(z - e)) / 2e-6, abs=1e-7)


def test_offending_sentences_are_located(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeghilmnoprst"), 6))
    plain = [word() for _ in range(200)]
    rows, bad = [], {}
    for i in range(300):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(rng.integers(3, 9))]
        if i % 2:
            at = sorted(rng.choice(len(sentences), min(2, len(sentences)), replace=False).tolist())
            for k in at:
                sentences[k] = f"{sentences[k]} du zorkverflucht é"
            bad[i] = [sentences[k] for k in at]
        text = "... ".join(sentences)
        if i == 1:
            text = ". ".join([text, *(" ".join(rng.choice(plain, 6)) for _ in range(500))])  # labelled texts of any length take part
        rows.append((i, text, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    for r in toxicity.score(docs, model).collect():
        assert (r["toxic_score"] >= 0.5) == (r["doc_id"] in bad)
        assert [r["text"][s["start"] : s["end"]] for s in r["offending"]] == bad.get(r["doc_id"], [])


# sharding


def test_differencing_beats_greedy_and_comes_near_the_best_split():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 100, 9)
        v = np.zeros((9, 2), np.int64)
        v[:, 0] = sizes
        slots = sharding.differencing(v)[:, 0]
        spread = abs(sizes[slots == 0].sum() - sizes[slots == 1].sum())
        best = min(abs(2 * sum(c) - sizes.sum()) for k in range(10) for c in itertools.combinations(sizes.tolist(), k))
        assert best <= spread <= best + 12
    better = 0
    for _ in range(20):
        sizes = np.sort((rng.pareto(1.5, 400) * 1000 + 1).astype(int).clip(1, 20_000))[::-1]
        v = np.zeros((400, 8), np.int64)
        v[:, 0] = sizes
        slots = sharding.differencing(v)
        assert all(sorted(s) == list(range(8)) for s in slots.tolist())
        mine, greedy = np.bincount(slots[:, 0], sizes, 8), np.zeros(8)
        for x in sizes:
            greedy[np.argmin(greedy)] += x
        better += np.ptp(mine) <= np.ptp(greedy)
    assert better >= 18


def test_shards_by_levels_and_with_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 20)
    rng = np.random.default_rng(6)
    rows = [(i, "same text" if i % 3 == 0 else "x" * int(rng.integers(1, 300))) for i in range(3000)] + [(5, None), (5, None), (None, "id-less")]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=5, block=8).collect()
    assert len(got) == len(rows)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values())


# language model


def test_sums_are_those_of_a_dense_model():
    """What a step gathers equals plain loops over tokens, features and outcomes."""
    rng = np.random.default_rng(0)
    lay = langmodel.Layout(11)
    w = rng.normal(size=(lay.rows, 16)).astype(np.float32) * 0.3
    tok = rng.integers(0, 20, 60).astype(np.uint64)
    pick = rng.choice([3, 17, 239, 250, 470, langmodel.END_CLASS, langmodel.OTHER_CLASS], 20)
    cls, word, at = pick[tok.astype(int)], rng.integers(0, 16, 60), np.array([0, 25, 60])
    bias = tuple(rng.normal(size=s).astype(np.float32) for s in ((langmodel.OUT,), (2 * langmodel.GROUPS, langmodel.SUB), (langmodel.FINE, langmodel.WORDS)))
    h = langmodel.features(tok, at, cls)
    sums, model = langmodel.Sums(lay), langmodel.Scorer(lay, w, bias)
    for i in range(0, 60, 7):  # batches don't matter
        sums.add(model, h[:, i : i + 7], cls[i : i + 7], word[i : i + 7])
    sums.flush()
    seen, expected = np.zeros_like(sums.seen), np.zeros_like(sums.seen)
    total = 0.0
    for i in range(60):
        c = int(cls[i])
        path = [(0, 0, c // 16 if c < 480 else 30 + (c == langmodel.OTHER_CLASS))]
        if c < 480:
            path.append((1, c // 16, c % 16))
        if c < 240:
            path.append((2, c, int(word[i])))
        for factor, condition, out in path:
            rows = lay.buckets(h[:, i : i + 1], np.array([condition]), factor)[:, 0]
            z = lay.own(w, factor)[condition] + bias[factor].reshape(-1, lay.wide[factor])[condition] + sum(lay.table(w, factor)[r] for r in rows)
            p = np.exp(z - z.max())
            p /= p.sum()
            total += np.log10(p[out])
            for t in [lay.table(seen, factor)[r] for r in rows] + [lay.own(seen, factor)[condition]]:
                t[out] += 1
            for t in [lay.table(expected, factor)[r] for r in rows] + [lay.own(expected, factor)[condition]]:
                t += p
    assert np.allclose(sums.seen, seen) and np.allclose(sums.expected, expected, atol=1e-4)
    # the tokens before a text don't count: features of a text don't change with its neighbours
    assert (langmodel.features(tok[25:], np.array([0, 35]), cls[25:]) == h[:, 25:]).all()
    v = langmodel.Vocabulary(*([np.zeros(0)] * 4), np.ones(langmodel.CLASSES), np.ones(langmodel.FINE * 16), 1, 1, 1)
    lp = langmodel.log_probabilities(model, v, h, cls, word, np.ones(60))
    shared = (cls == langmodel.OTHER_CLASS).sum() * np.log10(2)
    assert lp.sum() == pytest.approx(total - shared, rel=1e-5)


def test_columns_of_masses_and_the_order_of_tokens_do_not_matter():
    """A token's sums and its score are the same wherever it stands; factors are runs of tokens in order of class."""
    rng = np.random.default_rng(7)
    lay = langmodel.Layout(11)
    w = rng.normal(size=(lay.rows, 16)).astype(np.float32) * 0.3
    n = 3 * langmodel.BATCH // 2
    tok = rng.integers(0, 900, n).astype(np.uint64)
    cls, word = rng.permutation(langmodel.CLASSES)[(tok % np.uint64(langmodel.CLASSES)).astype(int)], (tok % np.uint64(16)).astype(int)
    bias = tuple(rng.normal(size=s).astype(np.float32) for s in ((langmodel.OUT,), (2 * langmodel.GROUPS, langmodel.SUB), (langmodel.FINE, langmodel.WORDS)))
    h, v, model = langmodel.features(tok, np.array([0, n]), cls), langmodel.Vocabulary(*([np.zeros(0)] * 4), np.ones(langmodel.CLASSES), np.ones(langmodel.FINE * 16), 1, 1, 1), langmodel.Scorer(lay, w, bias)
    order, sums = rng.permutation(n), [langmodel.Sums(lay) for _ in range(2)]
    for s, o in zip(sums, (np.arange(n), order), strict=True):
        s.add(model, h[:, o], cls[o], word[o])
        s.flush()
    assert np.allclose(sums[0].expected, sums[1].expected) and (sums[0].seen == sums[1].seen).all()
    assert sums[0].seen.sum() == pytest.approx(sums[0].expected.sum())
    lp = langmodel.log_probabilities(model, v, h, cls, word, np.ones(n))
    assert (langmodel.log_probabilities(model, v, h[:, order], cls[order], word[order], np.ones(n)) == lp[order]).all()
    mixed = langmodel.by_class(cls)
    assert [len(c) for c, _ in langmodel.factors(cls[mixed], word[mixed])] == [n, (cls < 2 * langmodel.FINE).sum(), (cls < langmodel.FINE).sum()]


@pytest.mark.parametrize("scale", [0.3, 30])
def test_masses_are_products_where_weights_allow_it(monkeypatch, scale):
    """Usual weights cost no exponential a token; those that could leave single precision are added up first. Both give the model's shares."""
    rng = np.random.default_rng(3)
    lay = langmodel.Layout(11)
    w = (rng.normal(size=(lay.rows, 16)) * scale).astype(np.float32)
    bias = tuple(rng.normal(size=s).astype(np.float32) for s in ((langmodel.OUT,), (2 * langmodel.GROUPS, langmodel.SUB), (langmodel.FINE, langmodel.WORDS)))
    model, rows, condition = langmodel.Scorer(lay, w, bias), rng.integers(0, 2048, (langmodel.FEATURES, 50)), rng.integers(0, 30, 50)
    exp = np.exp
    if scale < 1:
        monkeypatch.setattr(np, "exp", None)
    for factor, c in enumerate((np.zeros(50, int), condition, condition)):
        p = model.probabilities(factor, rows, c)
        masses = bias[factor].reshape(-1, lay.wide[factor]).astype(float)
        z = lay.own(w, factor)[c] + masses[c] - np.log(exp(masses).sum(axis=1))[c, None] + lay.table(w, factor)[rows].sum(axis=0, dtype=float)
        z = exp(np.minimum(z, 60))
        assert np.allclose(p, z / z.sum(axis=1, keepdims=True), rtol=1e-3 if scale > 1 else 1e-5, atol=1e-6)


@pytest.mark.parametrize("groups", [1, 5])
@pytest.mark.parametrize("most", [1, 4])
def test_counts_are_summed_by_key_and_group(groups, most):
    rng = np.random.default_rng(4)
    keys, g, n = rng.integers(0, 40, 600).astype(np.uint64) << np.uint64(58), rng.integers(0, groups, 600), rng.integers(1, most + 1, 600)
    want = Counter()
    for k, j, c in zip(keys.tolist(), g.tolist(), n.tolist(), strict=True):
        want[k, j] += c
    k, j, c = langmodel.summed(keys, g, n)
    assert dict(zip(zip(k.tolist(), j.tolist(), strict=True), c.tolist(), strict=True)) == want and k.dtype == np.uint64


def test_a_byte_table_is_an_index():
    data = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    for to in (wordhash.TO_LOWER, wordhash.SPACE):
        got = wordhash.mapped(data, to)
        assert got.dtype == to.dtype and (got == to[data]).all() and len(wordhash.mapped(data[:0], to)) == 0


def test_few_tasks_sums_meet_without_a_table(spark, monkeypatch):
    """Up to 64 tasks' sums are shuffled once and written nowhere."""
    stored = []
    monkeypatch.setattr(common.Workspace, "store", lambda self, df, name, parts=None, had=common.Workspace.store: (stored.append(name), had(self, df, name, parts))[1])
    docs = spark.createDataFrame([(i, "mia of tria duo of mia " * (i % 3)) for i in range(40)], "doc_id long, text string")
    assert langmodel.score_documents(docs, F.col("doc_id") % 7 == 2).count() == 40
    assert "counts" in stored and "sums" not in stored


def test_a_step_raises_the_likelihood():
    rng = np.random.default_rng(1)
    lay = langmodel.Layout(11)
    w = np.zeros((lay.rows, 16), np.float32)
    tok = np.tile(np.arange(10), 200).astype(np.uint64)
    cls, word = (tok.astype(int) * 37) % 480, (tok.astype(int) * 5) % 16
    bias = tuple(np.zeros(s, np.float32) for s in ((langmodel.OUT,), (2 * langmodel.GROUPS, langmodel.SUB), (langmodel.FINE, langmodel.WORDS)))
    h, at = langmodel.features(tok, np.array([0, 2000]), cls), []
    for _ in range(5):
        sums = langmodel.Sums(lay)
        model = langmodel.Scorer(lay, w, bias)
        sums.add(model, h, cls, word)
        sums.flush()
        p = model.probabilities(0, lay.buckets(h, np.zeros(2000, int), 0), np.zeros(2000, int))
        at.append(np.log(p[np.arange(2000), cls // 16]).mean())
        w = langmodel.step(lay, w, sums.seen, sums.expected)
    assert at == sorted(at) and at[0] == pytest.approx(-np.log(32), abs=1e-4) and at[-1] > -1.5


def test_capped_groups():
    points = np.random.default_rng(0).normal(size=(100, 4))
    group = langmodel.capped_groups(points / np.linalg.norm(points, axis=1, keepdims=True), 8, 16)
    assert np.bincount(group).max() <= 16 and set(group) <= set(range(8))


# token ids


def test_index_is_minimal_perfect_and_read_by_places():
    keys = np.unique(np.random.default_rng(3).integers(-(1 << 60), 1 << 60, 5000))
    seq, offset, size = np.arange(len(keys)) // 100, np.arange(len(keys)) * 2, np.full(len(keys), 2)
    blob, read = idstore.build_index(keys, seq, offset, size), []

    def at(place, n):
        read.append(n)
        return blob[place : place + n]

    index = idstore.Index(at)
    found, entry = index.lookup(keys)
    assert found.all() and (entry["offset"] == offset).all() and (entry["seq"] == seq).all() and not index.lookup(keys + 1)[0].any()
    assert len(blob) < len(keys) * (idstore.ENTRY.itemsize + 1.5)  # one entry for each key
    for i in range(0, 5000, 500):
        read.clear()
        assert index.find(int(keys[i])) == (seq[i], offset[i], 2) and index.find(int(keys[i]) + 1) is None
        assert sum(read) < 1000
    none = idstore.build_index(*[np.zeros(0, np.int64)] * 4)
    assert idstore.Index(lambda a, n: none[a : a + n]).find(5) is None


def test_raw_shards_and_keyed_reads(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(idstore.tokenizer_path("byte_bpe_50k.json"))
    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"more {i % 3}") for i in range(100)] + [(None, "x")] * 5
    out = f"{tmp_path}/ids"
    idstore.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), out, shard_ids=20)
    shards = idstore.manifest(spark, out).collect()
    assert len(shards) > 10 and all(r["n_ids"] < 30 for r in shards)  # also inside the run of one key, and of none
    ids = {x: [*t.encode(x, add_special_tokens=False).ids, 0] for _, x in rows}
    raw = b"".join((tmp_path / "ids" / f"ids-{r['part']:05d}-{r['seq']:05d}.bin").read_bytes() for r in sorted(shards))
    assert len(raw) == 2 * sum(len(ids[x]) for _, x in rows) and {r["width"] for r in shards} == {2}
    monkeypatch.setattr(idstore, "vocabulary_size", lambda path: 70_000)  # ids of 32 bits
    idstore.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"{out}-wide", shard_ids=20)
    assert idstore.Store(spark, f"{out}-wide").fetch(33) == ids["text 33"] and idstore.read_documents(spark, f"{out}-wide").count() == len(rows)
    store = idstore.Store(spark, out)
    assert store.fetch(33) == ids["text 33"] and store.ids_read == len(ids["text 33"])
    seven = store.fetch(7)
    assert store.ids_read == len(ids["text 33"]) + len(seven) and Counter(seven) == Counter(y for k, x in rows if k == 7 for y in ids[x])
    assert store.fetch(99) is None and store.fetch(-1) is None
    got = idstore.read_documents(spark, out).collect()
    assert Counter(r["ids_crc32"] for r in got) == Counter(zlib.crc32(np.array(ids[x], "<u4").tobytes()) for _, x in rows)
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


# near-duplicates


def test_recall_on_links_and_the_exact_way(spark):
    rng = np.random.default_rng(11)
    texts, links = {}, []
    for i in range(150):  # pairs on both sides of the threshold
        words = [f"w{x}" for x in rng.integers(0, 100_000, 150)]
        other = list(words)
        for k in rng.integers(0, 150, int(rng.integers(2, 7))):
            other[k] = f"v{i}-{k}"
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(other)
        a, b = ({tuple(w[k : k + 5]) for k in range(146)} for w in (words, other))
        if 100 * len(a & b) >= 75 * len(a | b):
            links.append(2 * i)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert 20 < len(links) < 140
    for exact in (False, True):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, exact=exact).collect()}
        assert [i for i in range(0, 300, 2) if got[i + 1] == i] == links  # recall 1, and no false link


def test_hot_buckets_and_centres_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "TOGETHER", 1)
    rng = np.random.default_rng(8)
    base, texts = [f"w{x}" for x in rng.integers(0, 10_000, 120)], {}
    for i in range(50):
        base = list(base)
        for k in rng.integers(0, 120, 2):
            base[k] = f"v{i}-{k}"
        texts[i] = " ".join(base)
    texts |= {100 + i: "one and the same short text" for i in range(20)}
    from test_operators import brute_components

    for exact in (False, True):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), exact=exact).collect()}
        assert got == brute_components(texts)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3), (None, "q r s t u v", 4), (None, "q r s t u v", 5), (5, "x y z", 6), (5, "m n o p", 7), (6, "m n o p", 8), (5, "zz yy", 9), (7, None, 1), (8, "", 2), (7, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    groups = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert groups == {(1, 1), (2, 1), (None, None), (5, 5), (6, 5), (7, 7), (8, 8)}
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(docs).collect()) == [0, 1, 5, 7, 8]


# language identification


def test_the_smallest_encoding_names_the_language(spark, sf):
    import zstandard as z

    docs = table(spark, sf, "documents").select("text", "lang")
    model = langid.fit(docs, texts=20, margin_texts=10)
    got = langid.identify(docs, model).collect()
    for r in got:
        text, n = r["text"].lower().encode(), {}
        for lang, content in model.contents.items():
            window = max(20, (len(content) + langid.CHUNK).bit_length())
            how = z.ZstdCompressionParameters(window_log=window, chain_log=18, hash_log=18, search_log=4, min_match=5, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            c = z.ZstdCompressor(compression_params=how, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT))
            n[lang] = sum(len(c.compress(text[i : i + langid.CHUNK])) for i in range(0, len(text), langid.CHUNK))
        if langid.has_letter(r["text"]):
            a, b = sorted(n.values())[:2]
            assert n[r["lang_pred"]] == a and (a == b or r["lang_margin"] == b - a) and r["lang_share"] == (b - a) / a
            assert r["rejected"] == (r["lang_share"] <= model.least_share)
        else:
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
    assert model.least_share > 0 and all(t in c for c in model.contents.values() for t in c.split(b"\n")[:1])


def test_texts_go_into_dictionaries_whole_and_ties_go_by_frequency(spark):
    long = " ".join(f"mot{i}" for i in range(20_000))
    docs = spark.createDataFrame([(long, "fr"), ("un deux trois", "fr"), ("one two three", "en")], "text string, lang string")
    contents = langid.fit(docs, margin_texts=0).contents
    assert list(contents) == ["fr", "en"] and long.encode() in contents["fr"]
    same = langid.Model({"fr": b"abc", "en": b"abc"}, 0.0)
    r = langid.identify(docs.limit(1), same).first()
    assert (r["lang_pred"], r["rejected"], r["lang_margin"]) == ("fr", True, 0.0)


# fingerprints


def plain_fingerprint(data):
    """Byte by byte: a chunk ends where the hash of the last 7 bytes is -1 modulo the block size."""

    def rolling(i):
        window = [*([0] * 7), *data[: i + 1]][-7:]
        h = 0
        for j, b in enumerate(reversed(window)):
            h = (h + int(ctph._BYTE[b]) * pow(int(ctph._STEP), j, 1 << 32)) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 12

    hashes = [rolling(i) for i in range(len(data))]
    block = 3
    while block * 64 < len(data):
        block *= 2

    def signature(size):
        out, begin = "", 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and len(out) < 63:
                out += sign(data[begin : i + 1])
                begin = i + 1
        return out + (sign(data[begin:]) if begin < len(data) else "")

    def sign(chunk):
        return ctph.SIGNS[int(span_hashes(np.frombuffer(chunk, np.uint8), np.array([0]), np.array([len(chunk)]))[0] >> np.uint64(58))]

    while sum(h % block == block - 1 for h in hashes) + 1 < 8 and block > 3:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(x, y):
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    if x == y:
        return 1.0

    def like(a, b):
        gate = max(1, min(7, min(len(a), len(b)) // 4))
        if not any(a[i : i + gate] in b for i in range(len(a) - gate + 1)) or not a or not b:
            return 0.0
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]  # edit distance with insertions and deletions
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                t[i][j] = i + j if not i or not j else min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] if a[i - 1] == b[j - 1] else 10**6)
        return 1 - t[-1][-1] / (len(a) + len(b))

    pairs = [(x1, y1), (x2, y2)] if bx == by else [(x1, y2)] if int(bx) == 2 * int(by) else [(x2, y1)] if 2 * int(bx) == int(by) else []
    return max([like(a, b) for a, b in pairs], default=0.0)


def test_fingerprints_are_those_of_plain_loops(spark, sf):
    texts = sorted((r["text"] for r in table(spark, sf, "documents").select("text").collect()), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    texts = [t.encode() for t in texts if len(t) < 3000][:40] + [b"", b"a", b"abcabc" * 100, "é€ß".encode() * 90]
    texts += [t[: len(t) * 2 // 3] + b" changed " + t[len(t) * 3 // 4 :] for t in texts[:20]]
    made = ctph.fingerprints(texts)
    strings = ctph.as_strings(*made)
    assert strings == [plain_fingerprint(t) for t in texts]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = ctph.likeness(tuple(x[i] for x in made), tuple(x[j] for x in made))
    want = [plain_likeness(strings[a], strings[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert np.allclose(got, want) and 0 < np.mean(np.array(want) > 0) < 1


def test_salted_join_splits_hot_keys_only(spark, monkeypatch):
    monkeypatch.setattr(common, "KEY_ROWS", 10)
    left = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(300)] + [(None, 1000)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(6)], "k int, r string")
    with Workspace(spark, "test") as work:
        for how in ("inner", "left"):
            got = sorted(map(tuple, common.salted_join(work, left, right, ["k"], F.col("v"), how).collect()), key=str)
            assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
