"""What keeps operators spread out when tables outgrow a broadcast, a part or a count of tasks."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import common, components, decontamination, idstore, langid, privacy
from strandline.llm.common import Workspace


def test_hot_terms_are_split(spark, monkeypatch):
    """Terms too many to broadcast: a word of a third of all places is dealt over several tasks, and results stay."""
    docs = spark.createDataFrame([(i, f"the red fox {i} " + "the " * 40 + f"jumps over item {i % 7} here now") for i in range(60)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "the the the jumps over item 3 here now"), (2, "the the the the"), (3, "no such words")], "item_id long, text string")
    key = lambda df: sorted(tuple(r) for r in df.drop("text_key").distinct().collect())
    want = key(decontamination.matches(docs, items)), key(decontamination.matches(docs, items, within=6))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "KEY_ROWS", 50)
    split = []
    real = common.salted_join
    monkeypatch.setattr(decontamination, "salted_join", lambda *a, **b: split.append(1) or real(*a, **b))
    assert (key(decontamination.matches(docs, items)), key(decontamination.matches(docs, items, within=6))) == want and want[0]
    assert len(split) >= 4
    with Workspace(spark, "t") as work:
        places = decontamination.split(docs, "doc_id", decontamination.text_key()).select("doc_id", "text_key", F.posexplode("w").alias("at", "word")).withColumn("term", decontamination.term(F.col("word")))
        terms = places.select("term").distinct()
        met = common.salted_join(work, places, terms, ["term"], F.struct("doc_id", "text_key", "at"))
        hot = met.where(F.col("word") == "the").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in hot) == 60 * 41 and len(hot) > 1


def test_components_have_no_fixed_number_of_files(spark):
    """With many partitions and no coalescing by size, links stay in as many tasks as the shuffle has."""
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with Workspace(spark, "t") as work:
            edges = spark.range(3000).select((F.col("id") - F.col("id") % 3).alias("a"), F.col("id").alias("b"))
            found = components.components(work, edges)
            assert found.inputFiles() and len(found.inputFiles()) > 64
            assert {r["node"]: r["component"] for r in found.collect()} == {i: i // 3 * 3 for i in range(3000) if i % 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_follow_the_input(spark):
    df = spark.range(100).repartition(23)
    assert common.lots_of(df) == 23 and common.lots_of(df.coalesce(2)) == 4


def test_index_is_read_once(tmp_path):
    """Looking up many shards' keys reads the index of their part one time."""
    keys = np.arange(5000) * 7
    raw, reads = idstore.build_index(keys, keys % 3, keys % 11, keys % 5 + 1), []
    index = idstore.Index(lambda at, n: reads.append(n) or raw[at : at + n])
    before = len(reads)
    for i in range(0, 5000, 500):
        found, entry = index.lookup(keys[i : i + 500])
        assert found.all() and (entry["offset"] == keys[i : i + 500] % 11).all()
    assert sum(reads[before:]) <= len(raw)


def test_one_language_names_every_text_with_letters(spark):
    texts = [("the quick brown fox jumps over the lazy dog and runs on. " * 4, "en"), ("some more plain words of the same language stand here.", "en"), ("and these are others, to set the margin by them.", "en")]
    model = langid.fit(spark.createDataFrame(texts * 3, "text string, lang string"))
    got = langid.identify(spark.createDataFrame([("zqx jvk wpf qqz",), ("the fox runs over the dog",), ("123",), (None,)], "text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["en", "en", "und", "und"] and [r["rejected"] for r in got][2:] == [True, True]
    assert all(0 <= r["lang_score"] <= 1 for r in got) and got[1]["lang_score"] >= got[0]["lang_score"]


def test_context_has_whole_words():
    text = "telefonnummernverzeichniseintragsuebersicht: 555 0100, und sehrlangewoerterdieabgeschnittenwuerden danach"
    start = text.index("555")
    before, after = privacy.around(text, start, start + 8)
    assert before.startswith("telefonnummern") and after.endswith("wuerden")
    assert privacy.around("x" * 10 + "5" * 4, 10, 14) == ("x" * 10, "")


def test_one_reliable_yes_outweighs_worthless_noes():
    """The learned posterior decides, not a count of votes."""
    model = privacy.Classifier(np.zeros(privacy.WIDTH), 0.0)
    vote = (1, -1, -1, 0, 0)
    at = privacy.features("call 555 now", 3, 5, 8, vote)
    model.weights[at[1]], model.weights[at[2]], model.weights[at[3]] = 6.0, -0.1, -0.1
    assert sum(vote) < 0 and model.adds(at)
