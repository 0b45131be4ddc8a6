"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds postings (term, text, place) of the training texts for the terms that test windows are looked
up by. A test window of WINDOW words is looked up by its two rarest terms (by the count over the whole
corpus): the list of the rarest is moved by the term's offset in the window, which gives places where the
window would begin, and is intersected with the list of the second, moved likewise: an equi-join on text,
term and place, so a frequent second term costs its postings and no more. What is left is fetched and
compared word for word. A proximity match joins the lists of all terms of a window around its rarest one.

A text is known by its document's id and its hash, so rows that share an id are told apart, and equal
rows share their postings. Terms that are in no window aren't posted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, ascii_lower, keep, packed, salted_join

WINDOW = 10
#: What parts words of a text whose case is kept: all ASCII signs but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Most bytes of a table that is broadcast; above, the join shuffles.
BROADCAST_BYTES = 8 << 20
TEXT = ("doc_id", "text_key")


def split(df: DataFrame, *names: Column | str) -> DataFrame:
    """The named columns and `w`, the words of text in their case; a null text has none."""
    return df.select(*names, words(F.col("text")).alias("w"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def term(word: Column) -> Column:
    """The 64-bit hash under which a word is listed; that two words share one costs time, not truth, as whole
    phrases are compared."""
    return F.xxhash64(folded(word))


def folded(word: Column) -> Column:
    """Lower case as the JVM has it, which is quicker than that of ASCII letters alone. Words that are
    equal in ASCII lower case are equal here too, as no letter's lower case depends on its neighbours here."""
    return F.lower(F.replace(word, F.lit("Σ"), F.lit("σ")))


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def met_by_term(work: Workspace, places: DataFrame, terms: DataFrame, n_bytes: int) -> DataFrame:
    """places joined with terms (key: term). Terms beyond BROADCAST_BYTES are shuffled, and a term with very many places is split."""
    if n_bytes <= BROADCAST_BYTES:
        return places.join(F.broadcast(terms), "term")
    return salted_join(work, places, terms, ["term"], F.struct(*TEXT, "at"))


def text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words: runs of `size` words of each item; an item of fewer (but not none) is one window."""
    w = split(items.select("item_id", ascii_lower(F.col("text")).alias("text")), "item_id").where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item_id", F.explode(F.transform(at, lambda i: F.slice(F.col("w"), i, size))).alias("words"))


def postings(work: Workspace, docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index over n_terms terms (their hashes): term, doc_id, text_key, at (in words, from 0), of whole texts."""
    bare = split(docs, "doc_id", text_key()).select(*TEXT, F.posexplode("w").alias("at", "word")).select(*TEXT, "at", term(F.col("word")).alias("term"))
    return met_by_term(work, bare, terms, 16 * n_terms).select("term", *TEXT, "at")


def _same_text(a: DataFrame, b: DataFrame) -> list[Column]:
    return [a["doc_id"].eqNullSafe(b["doc_id"]), a["text_key"] == b["text_key"]]


class Index:
    """Test windows, the counts of their terms in docs, and lists of postings; docs: doc_id, text; items: item_id, text."""

    def __init__(self, work: Workspace, docs: DataFrame, items: DataFrame, size: int):
        self.work, self.docs = work, docs
        self.each = work.store(windows(items, size), "windows")
        self.distinct = work.store(self.each.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "distinct")
        spread = self.distinct.select("window", F.posexplode("words").alias("offset", "word")).select("window", "offset", term(F.col("word")).alias("term"))
        terms = spread.select("term").distinct()
        n_terms = terms.count()
        found = split(docs).select(F.explode("w").alias("word")).select(term(F.col("word")).alias("term"))
        counted = lambda df: df.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        # Terms that can't be broadcast meet counts that tasks have summed up, not words.
        few = 16 * n_terms <= BROADCAST_BYTES
        self.counted = work.store(counted(found.join(F.broadcast(terms), "term")) if few else counted(found).join(terms, "term"), "counts")
        # A window with a term that no document has cannot occur.
        ranked = spread.join(self.counted, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        by_window = Window.partitionBy("window")  # at most `size` rows
        ranked = ranked.withColumn("rank", F.row_number().over(by_window.orderBy("n", "term", "offset"))).withColumn("least", F.min("n").over(by_window))
        self.ranked = work.store(ranked.where("least > 0").select("window", "offset", "term", "rank"), "ranked")

    def lists(self, terms: DataFrame) -> DataFrame:
        terms = terms.distinct()
        return self.work.store(postings(self.work, self.docs, terms, terms.count()), "postings")

    def exact(self) -> DataFrame:
        """doc_id, text_key, window, start, length of the places where a window's words stand one after another."""
        pivots = self.ranked.where("rank <= 2")
        index = self.lists(pivots.select("term"))
        one = pivots.where("rank = 1").select("window", "term", "offset")
        two = pivots.where("rank = 2").select("window", F.col("term").alias("term2"), F.col("offset").alias("offset2"))
        both = self.work.store(one.join(two, "window", "left"), "pivots")
        begun = met_by_term(self.work, index, both, 40 * both.count()).withColumn("start", F.col("at") - F.col("offset")).where("start >= 0")
        begun = begun.select(*TEXT, "window", "start", "term2", (F.col("start") + F.col("offset2")).alias("at2"))
        other = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("at").alias("a")).distinct()
        met = begun.where("term2 IS NOT NULL").join(other, (F.col("term2") == F.col("t")) & (F.col("text_key") == F.col("k")) & (F.col("at2") == F.col("a")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        met = met.unionByName(begun.where("term2 IS NULL")).select(*TEXT, "window", "start").distinct()
        met = self.work.store(met, "met")
        return self._confirmed(met)

    def _confirmed(self, met: DataFrame) -> DataFrame:
        """Of places where both terms stand, those with the window's words. Only texts that have such a place are read again."""
        held = met.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("n"))
        held = self.work.store(held, "held")
        texts = self.docs.select("doc_id", text_key(), "text")
        mine = held.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
        same = texts["doc_id"].eqNullSafe(mine["d"]) & (texts["text_key"] == mine["k"])
        few = texts.join(small(mine, 24 * held.count()), same, "left_semi").dropDuplicates([*TEXT])
        few = split(few, *TEXT)
        phrases = self.distinct.select("window", F.size("words").alias("length"), F.array_join("words", " ").alias("phrase"))
        n_bytes = phrases.agg(F.sum(F.octet_length("phrase") + 32)).first()[0] or 0
        # Places of a text and window are few beside its words: they meet as one row, and texts move once.
        places = met.groupBy(*TEXT).agg(F.collect_list(F.struct("window", "start")).alias("places"))
        at = few.join(places, _same_text(few, places)).select(few["doc_id"], few["text_key"], "w", F.explode("places").alias("p"))
        at = at.select(*TEXT, "w", F.col("p.window").alias("window"), F.col("p.start").alias("start")).join(small(phrases, n_bytes), "window")
        own = ascii_lower(F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " "))
        return at.where(own == F.col("phrase")).select(*TEXT, "window", "start", "length")

    def near(self, within: int) -> DataFrame:
        """doc_id, text_key, window, start, length: places of a window's rarest term that have each other term of
        the window within so many words on either side; start and length span the nearest ones (of equal ones the
        earlier). A window of one term is found wherever that stands."""
        by_term = Window.partitionBy("window", "term").orderBy("rank")
        terms = self.ranked.withColumn("r", F.row_number().over(by_term)).where("r = 1").select("window", "term", "rank")
        index = self.lists(terms.select("term"))
        anchors = met_by_term(self.work, index, terms.where("rank = 1").select("window", "term"), 24 * self.distinct.count()).select(*TEXT, "window", "at").distinct()
        rest = terms.where("rank > 1").select("window", "term")
        wanted = anchors.join(small(rest, 24 * 10 * self.distinct.count()), "window").withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / within) + i for i in (-1, 0, 1)])))
        other = index.select("term", F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("at").alias("there")).distinct().withColumn("block", F.floor(F.col("there") / within))
        met = wanted.join(other, ["term", "block"]).where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.abs(F.col("there") - F.col("at")) <= within))
        key = [*TEXT, "window", "at"]
        nearest = met.groupBy(*key, "term").agg(F.min(F.struct(F.abs(F.col("there") - F.col("at")).alias("far"), "there"))["there"].alias("there"))
        spans = nearest.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("there").alias("lo"), F.max("there").alias("hi"))
        needed = terms.groupBy("window").agg((F.count(F.lit(1)) - 1).alias("needed"))
        alone = anchors.join(needed.where("needed = 0"), "window").select(*TEXT, "window", F.col("at").alias("start"), F.lit(1).alias("length"))
        lo, hi = F.least("lo", "at"), F.greatest("hi", "at")
        several = spans.join(needed, "window").where("n = needed").select(*TEXT, "window", lo.alias("start"), (hi - lo + 1).alias("length"))
        return several.unionByName(alone).distinct()


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, within: int | None = None) -> DataFrame:
    """Where item windows occur in docs (doc_id, text): doc_id, text_key, item_id, start, length (in words).

    within: proximity instead of exact phrases, as in Index.near(). Null and empty texts of either side
    have no words; a null item_id is an item; equal windows of several items give a row for each item;
    repeated rows of docs give their rows once. No rows on either side give no rows.
    """
    with Workspace(docs.sparkSession, "dc") as work:
        return keep(_matches(work, docs, items, size, within), "dc-matches")


def _matches(work: Workspace, docs: DataFrame, items: DataFrame, size: int, within: int | None) -> DataFrame:
    index = Index(work, docs, items, size)
    hits = index.exact() if within is None else index.near(within)
    each = index.each.join(index.distinct, "words").select("window", "item_id").distinct()
    return hits.join(small(each, 24 * each.count()), "window").select(*TEXT, "item_id", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of any item window. Null and empty texts have no words; equal rows
    have equal results. items_sha256 is that of the item ids as strings, sorted and joined by commas (of the
    empty string where no item occurs); an item without an id counts in n_hit and n_items. Without items
    nothing is hit. Columns of docs with the name of a result give way to it; others, of any name, stay.
    """
    docs = docs.drop(*RESULTS)
    rows, unpack = packed(docs, "doc_id", "text")
    with Workspace(docs.sparkSession, "dc") as work:
        found = work.store(_matches(work, docs.select("doc_id", "text"), items.select("item_id", "text"), size, None), "matches")
        places = found.select(*TEXT, "start", "length").distinct()
        # Words covered by windows: merge overlapping runs in order of their starts.
        order = Window.partitionBy(*TEXT).orderBy("start", "length")
        reached = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0)))
        hit = places.withColumn("fresh", F.greatest(F.lit(0), fresh)).groupBy(*TEXT).agg(F.sum("fresh").alias("hit"))
        ids = found.select(*TEXT, F.col("item_id").cast("string").alias("item")).distinct()
        per_item = ids.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("sha"))
        marks = hit.join(per_item, _same_text(hit, per_item)).select(hit["doc_id"].alias("_id"), hit["text_key"].alias("_key"), "hit", "items", "sha")
        marks = keep(marks, "dc-marks")
    keyed = rows.select("doc_id", "text", "_rest", text_key(), F.size(words(F.col("text"))).cast("long").alias("n"))
    n_marks = marks.count()
    out = keyed.join(small(marks, 120 * n_marks), keyed["doc_id"].eqNullSafe(marks["_id"]) & (keyed["text_key"] == marks["_key"]), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    return out.select(*unpack(out), F.col("n").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
