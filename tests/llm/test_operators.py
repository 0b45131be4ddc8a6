"""Operators against brute force on the smallest tables, and on rows that are null, empty, long, equal or repeated."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, components, ctph, decontamination, idstore, langid, langmodel, neardup, packing, privacy, queries, sharding, tokens, toxicity
from strandline.llm.common import Workspace, table

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
EDGE = [
    (1, "Plain words stand here, seven of them."), (1, "Plain words stand here, seven of them."), (2, None), (3, ""), (None, "no id but text"), (None, None),
    (4, "   \n\t "), (5, "!!! ... 123"), (6, LONG), (7, LONG + " end"), (8, "Größe Ünïcode ΑΣ ﬁ    x"), (9, "<|endoftext|> mail a.b@c.de, +1 (212) 555-0100, 4111 1111 1111 1111"), (9, "another text under one id"),
]


#: Columns whose names operators use for results or inside.
CLASH = "lang string, n_words int, piece int, contaminated boolean, _id int, _key int, text_key string, toxic_score string, lang_pred int, _rest int, `a b` int, sequence_id int, n long, w string, node int, spans string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", 5, 1, True, 7, 8, "k", "s", 3, 4, 5, 6, 9, "w", 2, "sp") for i, t in EDGE]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_edge_rows(spark, edge, none):
    items = spark.createDataFrame([(1, "seven of them"), (2, None), (3, ""), (None, "no id but text")], "item_id long, text string")
    model = toxicity.fit(edge.select("doc_id", "text"), spark.createDataFrame([(1, 0), (8, 1), (None, 1), (77, 0)], "doc_id long, toxic int"))
    runs = {
        "op1": lambda d: decontamination.decontaminate(d, items),
        "op2": privacy.find,
        "op3": lambda d: toxicity.score(d, model),
        "op4": sharding.shard_documents,
        "op5": lambda d: langmodel.score_documents(d, d["doc_id"] == 3),
        "op6": idstore.encode_documents,
        "op7": neardup.near_duplicates,
        "op8": lambda d: langid.identify(d, langid.fit(d)),
        "op9": ctph.fingerprint_documents,
    }
    for name, run in runs.items():
        got = run(edge).collect()
        assert len(got) == len(EDGE), name
        assert run(none).collect() == [], name
    assert packing.pack_documents(none).collect() == []
    packed = packing.pack_documents(edge).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) and sum(r["doc_id"] == 1 for r in packed) == 2
    marked = decontamination.decontaminate(edge, items)
    assert [c for c in marked.columns if c not in decontamination.RESULTS] == [c for c in edge.columns if c not in ("n_words", "contaminated")]
    hit = [r for r in marked.collect() if r["contaminated"]]
    assert {(r["doc_id"], r["n_hit"], r["n_items"], r["_id"], r["_key"]) for r in hit} == {(1, 3, 1, 7, 8), (None, 4, 1, 7, 8)}
    near = defaultdict(set)
    for r in neardup.near_duplicates(edge).collect():
        near[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert near[7] == {(6, False)} and near[6] == {(6, True)} and near[None] == {(None, True)} and near[3] == {(3, True)}
    named = langid.identify(edge, langid.fit(edge))
    assert {r["lang_pred"] for r in named.where("doc_id in (2, 3, 4, 5)").collect()} == {"und"} and named.where("doc_id in (2, 3, 4, 5) and not rejected").count() == 0
    scored = toxicity.score(edge, model)
    assert {r["toxic_score"] for r in scored.where("doc_id in (2, 3, 4)").collect()} == {0.0} and scored.where("`a b` = 5 and _rest = 4").count() == len(EDGE)
    spans = defaultdict(set)
    for r in privacy.find(edge).collect():
        spans[r["doc_id"]].add(r["spans"])
    assert spans[9] == {"email:19:27,card:48:67,phone:29:46", ""} and spans[2] == spans[3] == {""}
    clean = privacy.redact(edge)
    assert clean.columns == edge.columns and "<EMAIL>, <PHONE>, <CARD>" in "".join(r["text"] or "" for r in clean.collect())
    sharded = sharding.shard_documents(edge).collect()
    assert len({(r["shard"], r["slot"]) for r in sharded}) == len(EDGE) and {r["size"] for r in sharded if r["doc_id"] in (2, 3)} == {1}
    one_end = {(r["doc_id"], r["n_tokens"]) for r in idstore.encode_documents(edge).collect() if r["doc_id"] in (2, 3)}
    assert one_end == {(2, 1), (3, 1)}
    lm = by_id(langmodel.score_documents(edge, F.col("doc_id") == 3))
    assert (lm[2]["n_tokens"], lm[3]["n_tokens"], lm[3]["held_out"]) == (1, 1, True) and all(r["score"] <= 0 for r in lm.values())
    prints = by_id(ctph.fingerprint_documents(edge))
    assert prints[2]["n_chars"] == 0 and prints[2]["fingerprint"] == prints[3]["fingerprint"]


def test_decontamination(spark, sf, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = {r["item_id"]: word.findall(lower(r["text"])) for r in table(spark, sf, "benchmark").collect()}
    windows = defaultdict(set)
    for i, w in items.items():
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(i)
    got = by_id(queries.op1_decontamination(spark, sf))
    for d, t in docs.items():
        w, hit, found = word.findall(lower(t)), set(), set()
        for k in range(len(w) - 9):
            if own := windows.get(tuple(w[k : k + 10])):
                hit |= set(range(k, k + 10))
                found |= own
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_decontamination_by_shuffle_and_proximity(spark, sf, monkeypatch):
    d, b = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    want = sorted(map(tuple, decontamination.matches(d, b).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert want and sorted(map(tuple, decontamination.matches(d, b).collect())) == want
    x = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x x x x beta")], "doc_id long, text string")
    near = decontamination.matches(x, spark.createDataFrame([(5, "alpha beta")], "item_id long, text string"), within=3).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in near) == [(1, 0, 4), (2, 0, 2)]


def test_privacy(spark, sf, docs):
    got = by_id(queries.op2_privacy(spark, sf))
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and privacy.luhn(re.sub(r"\D", "", s)), "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15}
    for d, t in docs.items():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in rx.items() for m in re.finditer(p, t or "") if ok[k](m[0])]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(filter(None, got[d]["spans"].split(",")))
    clean = privacy.redact(table(spark, sf, "documents").select("doc_id", "text")).collect()
    assert all(not privacy.base_spans(r["text"]) for r in clean)


def test_emails_are_those_of_the_pattern():
    p = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c@d.e", "@x.y", "a@b", "x@@y.z", "a@b.c.d@e.f", "é@b.c", "a..b@c-.d_e@f.g", "@" * 9):
        assert list(privacy._emails(t)) == [m.span() for m in p.finditer(t)]


def test_toxicity(spark):
    got = [r for r in queries.op3_toxicity(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    toxic = [r["score"] for r in got if labels.get(r["doc_id"]) == 1]
    clean = [r["score"] for r in got if labels.get(r["doc_id"]) == 0]
    assert np.mean([x > y for x in toxic for y in clean]) > 0.8
    assert all((r["offending"] != "") == (r["predicted"] == 1) for r in got)


def test_sharding(spark, sf, docs):
    got = queries.op4_sharding(spark, sf).collect()
    slots, sums, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        t = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        where[docs[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert max(sums.values()) - min(sums.values()) < 0.02 * sum(sums.values())


@pytest.mark.parametrize("head", [1_000_000, 500])
def test_language_model(spark, sf, docs, monkeypatch, head):
    monkeypatch.setattr(langmodel, "HEAD", head)
    got = by_id(queries.op5_lm_scores(spark, sf))
    toks = {d: (t or "").encode().lower().split() + [None] for d, t in docs.items()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(w for d, ws in toks.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in toks.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[d], len(ws), sum(c[w] > 0 for w in ws), n)
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert r["base_score"] == pytest.approx(want, rel=1e-10)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held) and sum(r["score"] for r in got.values()) > 0.93 * sum(r["base_score"] for r in got.values())


def test_language_model_gains_with_more_texts(spark):
    held = [r for r in queries.op5_lm_scores(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.96 * sum(r["base_score"] for r in held)
    assert np.mean([r["score"] > r["base_score"] for r in held]) > 0.9


def test_language_model_depends_neither_on_the_head_nor_on_the_layout(spark, sf, monkeypatch):
    d = table(spark, sf, "documents").select("doc_id", "text")
    runs = []
    for head, parts in ((1_000_000, 1), (500, 16), (0, 5)):
        monkeypatch.setattr(langmodel, "HEAD", head)
        runs.append(by_id(langmodel.score_documents(d.repartition(parts), queries.crc_mod(F.col("doc_id"), 7) == 2)))
    for other in runs[1:]:
        assert all(other[k]["score"] == pytest.approx(r["score"], rel=1e-6) and other[k]["base_score"] == r["base_score"] for k, r in runs[0].items())


def test_clusters_come_from_all_texts(spark):
    """The frequent words are those of all texts, long ones and those beyond any sample included; so are their neighbours."""
    texts = [f"short text number n{i} of many" for i in range(2500)] + ["mia duo " * 4000 + "tria"]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    top = np.sort(langmodel.frequent_tokens(training))
    key = {w: int(langmodel.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in ("mia", "duo", "short", "text", "of", "tria")}
    assert {key[w] for w in ("mia", "duo", "short", "text", "of")} <= set(top.tolist())
    m, at = langmodel.neighbours(training, top), {w: int(np.searchsorted(top, np.uint64(k))) for w, k in key.items()}
    assert m[at["mia"], at["duo"]] == pytest.approx(4000 + 3999 / 3) and m[at["mia"], at["mia"]] == pytest.approx(3999 / 2)
    assert m[at["short"], at["text"]] == 2500 and m[at["of"], at["short"]] == 0


def test_words_of_a_rare_language_get_classes(spark):
    rng = np.random.default_rng(4)
    common = [" ".join(f"c{x}" for x in rng.integers(0, 600, 200)) for _ in range(60)]
    rare = [" ".join(w for x in rng.integers(0, 40, 8) for w in (f"r{x}", f"s{x}")) for _ in range(8)]
    training = spark.createDataFrame([(t,) for t in common + rare], "text string")
    got = {r["token"]: r["class"] for r in langmodel.count_tokens(training, langmodel.frequent_words(training)).collect()}
    words = [f"s{x}".encode() for x in range(40)]
    tok, _ = langmodel.tokens(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(b" ".join(words))]))
    assert len({got[t] for t in tok.view(np.int64).tolist() if t in got}) > 5


def test_token_ids(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    got, start = by_id(queries.op6_token_ids(spark, sf)), 0
    for d in sorted(docs):
        ids = t.encode(docs[d] or "", add_special_tokens=False).ids + [0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_of_odd_texts():
    from tokenizers import Tokenizer

    texts = ["a   y  b\n\nq ", "", "  x", "foo <|endoftext|>bar \n<|endoftext|>  Z", "it's DON'T 12 34a", "ẛ̣ Å ΑΣ ", "x \n\n  y\t\tz\n", "x   y", "'s'tve 'Re", "   a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for name, words in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = tokens.tokenizer_path(name)
        ids, n = tokens.ChunkEncoder(path, words).encode(data, off)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def brute_components(docs):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in docs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(sets[d]), top(d)) for d in docs}


def test_near_duplicates(spark, sf, docs):
    got = by_id(queries.op7_neardup(spark, sf))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(docs)


def test_near_duplicates_that_only_link_in_chains(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    texts = {}
    for i in range(60):  # a family of drifting copies
        base = list(base)
        for k in rng.integers(0, 120, 2):
            base[k] = f"v{i}-{k}"
        texts[i] = " ".join(base)
    got = by_id(neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7)]
    with Workspace(spark, "test") as work:
        got = {r["node"]: r["component"] for r in components.components(work, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    for share in (300, 600, 800):
        b = np.concatenate([a[:share], rng.integers(0, 1 << 63, 900 - share, dtype=np.int64).astype(np.uint64)])
        ra, rb = (neardup.exponential_registers(neardup.registers(x))[None] for x in (a, b))
        j = neardup.joint_estimate(ra, rb, np.array([900.0]), np.array([900.0]))[0]
        assert abs(j - share / (1800 - share)) < 0.08


def test_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = [r for r in queries.op8_langid(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got]) > 0.95


def test_narrow_margins_are_rejected(spark):
    """Texts of an unlearned language and random letters go; those of learned languages stay, be it one or three."""
    import corpus_pipeline as p

    rng = np.random.default_rng(6)
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 200 and lang is not null").select("doc_id", "text", "lang")
    junk = [(-i, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(50)), None) for i, letters in enumerate(["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрсту"] * 20, 1)]
    for learned in (["en", "fr", "es"], ["en"]):
        docs = rows.selectExpr("doc_id", "text", f"CASE WHEN lang IN ({str(learned)[1:-1]}) THEN lang END AS lang").union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
        stay = {r["doc_id"] for r in p.language_id(spark, docs, "").collect()}
        known, other = ({r["doc_id"] for r in rows.where(f"lang {how} ({str(learned)[1:-1]})").collect()} for how in ("IN", "NOT IN"))
        assert len(known & stay) > 0.99 * len(known) and len(other & stay) < 0.05 * len(other)
        assert len({d for d in stay if d < 0}) <= 2  # of 40


def test_fingerprints(spark, sf, docs):
    got, ids = by_id(queries.op9_fingerprints(spark, sf)), sorted(docs)
    prints = defaultdict(set)
    for d, after in zip(ids, ids[1:] + ids[:1]):
        t, k = docs[d], len(docs[d]) // 2
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + docs[after][:k]).encode()).hexdigest()
        prints[t].add(got[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 and np.mean([r["near_next"] for r in got.values()]) < 0.05


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    rows, total = queries.op10_packing(spark, sf).collect(), 0
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        own = sorted(parts[d], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(k, min(4096, len(ids) - k)) for k in range(0, len(ids), 4096)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= -(-total // 4096) + 1


def test_fullest_is_the_best_subset():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(40):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 30, 4), rng.integers(1, 4, 4), strict=True)}
        room = int(rng.integers(5, 60))
        best = max(s for ks in product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts, strict=True))) <= room)
        used = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    d, kept = table(spark, sf, "documents"), {}
    for name, stage in p.STAGES[:-1]:
        out, path = stage(spark, d, sf), p.shared_path(spark, f"test-{name}")
        assert out.columns == d.columns
        out.write.parquet(path)
        d = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in d.collect()}
    assert len(kept["language_id"]) > 0.95 * len(docs)
    comp = brute_components(kept["language_id"])
    assert set(kept["near_dedup"]) == {i for i, (_, c) in comp.items() if i == c}
    assert set(kept["decontamination"]) == set(kept["pii"]) and all(not privacy.base_spans(t) for t in kept["pii"].values())
    assert {r["doc_id"] for r in p.run(spark, sf).collect()} == set(kept["pii"])


def test_pipeline_leaves_columns_of_any_name_alone(spark, sf):
    import corpus_pipeline as p

    d = table(spark, sf, "documents").selectExpr("*", "7 AS n_words", "true AS contaminated", "1 AS _id", "2 AS _key", "'x' AS lang_pred", "3 AS _rest", "4 AS c0", "'y' AS rejected", "5 AS text_key", "6 AS `a b`")
    for name, stage in p.STAGES[:-1]:
        d = stage(spark, d, sf)
        path = p.shared_path(spark, f"test-{name}")
        d.write.parquet(path)
        d = spark.read.schema(d.schema).parquet(path)
        assert [r.asDict() for r in d.select("n_words", "contaminated", "_id", "_key", "lang_pred", "_rest", "c0", "rejected", "text_key", "`a b`").distinct().collect()] == [
            {"n_words": 7, "contaminated": True, "_id": 1, "_key": 2, "lang_pred": "x", "_rest": 3, "c0": 4, "rejected": "y", "text_key": 5, "a b": 6}
        ], name
    assert p.packing(spark, d, sf).count() >= d.count()
    none = d.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_results_outlive_other_runs_and_nothing_else_is_left(spark, edge, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    held = neardup.near_duplicates(edge)
    decontamination.decontaminate(edge, spark.createDataFrame([(1, "seven of them")], "item_id long, text string")).count()
    packing.pack_documents(edge)
    assert held.count() == len(EDGE)
    left = sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path) if not x.startswith("."))
    assert left == ["dc-marks", "nd-groups", "packed"]
    with pytest.raises(ZeroDivisionError), Workspace(spark, "broken") as work:
        work.store(edge, "x")
        1 / 0  # noqa: B018
    assert sorted(x.rsplit("-", 1)[0] for x in os.listdir(tmp_path) if not x.startswith(".")) == left
