"""Quality rules as a ledger of failure bits, in DataFrame operations only.

Every rule is evaluated once, over whole texts. The ledger has a row for each document: what was measured, and
`failures`, a mask with a bit for each rule that failed. Policies are versions of masks: which bits remove a document
at once, and how many of some others it may have. They are applied to the ledger, as are ablations (what another
policy, or one without a rule, would keep): both are bit operations on `failures`, and no text is read again.

All thresholds compare whole numbers, so a verdict doesn't depend on rounding. Nothing is shuffled to build a
ledger: repeated words are found by sorting a text's windows inside its own row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import keep, packed, prepare

#: Fixed value: what parts words.
SPACE = " \t\n\x0b\f\r"
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_bullet_lines", "n_cut_lines")


def _rules() -> dict[str, Column]:
    """What fails each rule, in the order of their bits; new rules go to the end, so that old ledgers stay readable."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "many_words": n > 100_000,
        "short_words": F.col("word_chars") < 3 * n,
        "long_words": F.col("word_chars") > 10 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * lines,
        "few_letters": 100 * F.col("n_letter_words") < 80 * n,
        "bullets": 100 * F.col("n_bullet_lines") > 90 * lines,
        "cut_lines": 100 * F.col("n_cut_lines") > 30 * lines,
    }


RULES = ("few_words", "repeated_words", "many_words", "short_words", "long_words", "symbols", "repeated_lines", "few_letters", "bullets", "cut_lines")


def mask(*rules: str) -> int:
    return sum(1 << RULES.index(r) for r in rules)


class Policy(NamedTuple):
    """hard: bits of which none may be set; soft: bits of which at most `allowed` may be."""

    hard: int
    soft: int = 0
    allowed: int = 0


BASE = mask("few_words", "repeated_words")
#: Versions are never changed once used; a new one gets a new name.
POLICIES = {
    "base": Policy(BASE),
    "v1": Policy(BASE | mask("short_words", "long_words", "symbols", "few_letters"), mask("repeated_lines", "bullets", "cut_lines"), 1),
    "strict": Policy((1 << len(RULES)) - 1),
}
CURRENT = "v1"


def removed(failures: Column, policy: Policy) -> Column:
    """Whether a policy removes a document with these failures."""
    out = failures.bitwiseAND(F.lit(policy.hard)) != 0
    return out | (F.bit_count(failures.bitwiseAND(F.lit(policy.soft))) > policy.allowed) if policy.soft else out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, text to doc_id, MEASURES (long), with all other columns of docs as they are; columns with these names give way.

    A null text is an empty one and has no words. Lines are split at \\n; one without a word counts nowhere.
    n_repeat_words counts words inside 3-word windows that stand twice or more in the text.
    """
    rows, unpack = packed(docs.drop(*MEASURES), "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")
    # Words without a letter, found from one space to the next.
    bare = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])"))
    ends = lambda x, what: F.endswith(F.rtrim(x, F.lit(SPACE)), F.lit(what))
    cut = rows.select("doc_id", "text", "_rest", words.alias("w"), has_word.alias("lines"), symbols.alias("n_symbols"), bare.alias("bare"))
    size, n = F.size, F.greatest(F.size("w") - 2, F.lit(0))
    three = [F.slice("w", i + 1, n).alias(c) for i, c in enumerate("abc")]
    counted = cut.select(
        "doc_id", "text", "_rest", "n_symbols", "w", F.transform(F.arrays_zip(*three), lambda x: F.xxhash64(x)).alias("h"),
        size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), size("lines").cast("long").alias("n_lines"),
        (size("lines") - size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (size("w") - F.col("bare")).cast("long").alias("n_letter_words"),
        size(F.filter("lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[*•-]"))).cast("long").alias("n_bullet_lines"),
        size(F.filter("lines", lambda x: ends(x, "...") | ends(x, "…"))).cast("long").alias("n_cut_lines"),
    )
    # Texts whose windows all have different hashes repeat none; the windows of the others are sorted, and equal ones
    # then stand next to each other.
    windows = F.arrays_zip(*three, F.sequence(F.lit(1), n).alias("at"))
    own = F.when(size("h") > size(F.array_distinct("h")), F.sort_array(windows))
    some = counted.select(*[c for c in counted.columns if c not in ("w", "h")], own.alias("s"))
    beside = F.arrays_zip(F.col("s").alias("x"), F.slice("s", 2, size("s") - 1).alias("y"))
    equal = F.filter(beside, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    covered = F.flatten(F.transform(equal, lambda p: F.array(*[p[k]["at"] + i for k in "xy" for i in range(3)])))
    out = some.withColumn("n_repeat_words", F.when(F.col("s").isNotNull(), size(F.array_distinct(covered))).otherwise(0).cast("long"))
    return out.select(*unpack(out), *MEASURES)


def ledger(docs: DataFrame, store: bool = True) -> DataFrame:
    """docs without text, plus MEASURES and failures (long: bit i is set if rule i of RULES failed), stored as Parquet.

    Every row gets its own, repeated ones and those without an id too; an empty or null text fails few_words.
    No rows give no rows. Columns of docs named like a result give way to it. A text of many megabytes is
    sorted in its own row, in memory.
    """
    prepare(docs.sparkSession)
    out = measure(docs.drop("failures")).drop("text")
    rules = _rules()
    bits = sum((F.when(rules[r], 1 << i).otherwise(0).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    out = out.withColumn("failures", bits)
    return keep(out, "quality-ledger") if store else out


def judge(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger plus base_failed, kept (the version's verdict) and sole_rule: the rule without which a removed document
    would stay, if there is exactly one. Columns with these names give way."""
    policy, failures = POLICIES[version], F.col("failures")
    out = removed(failures, policy)
    # Bits without which a removed document would stay; where a soft limit is passed by one, any of several could go.
    spare = [(1 << i, ~removed(failures.bitwiseAND(F.lit(~(1 << i))), policy) & (failures.bitwiseAND(F.lit(1 << i)) != 0)) for i in range(len(RULES)) if (policy.hard | policy.soft) >> i & 1]
    ways = sum((F.when(c, bit).otherwise(0) for bit, c in spare), F.lit(0))
    alone = F.coalesce(*[F.when(ways == 1 << i, F.lit(r)) for i, r in enumerate(RULES)])
    base = failures.bitwiseAND(F.lit(BASE)) != 0
    return entries.withColumns({"base_failed": base, "kept": ~(base | out), "sole_rule": F.when(out, alone)})


def patterns(entries: DataFrame, *by: str) -> DataFrame:
    """by, failures, n_docs, n_words: a ledger summed by its masks. All that follows needs no more than this."""
    return entries.groupBy(*by, "failures").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


def ablations(entries: DataFrame, version: str = CURRENT, *by: str) -> DataFrame:
    """For each group of `by` and each rule: what the version removes, and would keep without the rule.

    by, version, rule, n_failed (documents that fail it), n_removed (by the version), n_sole and words_sole (removed, but
    kept without the rule), ever_failed and always_failed (bit-or and bit-and of all failures in the group, as rule
    names). A null group is a group. No rows give no rows.
    """
    policy, bits = POLICIES[version], F.col("failures")
    found = patterns(entries, *by)
    each = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(RULES) - 1))).alias("rule_at"))
    bit = F.expr("shiftleft(1L, rule_at)")
    without = bits.bitwiseAND(F.bitwise_not(bit))
    sole = removed(bits, policy) & ~removed(without, policy)
    count = lambda c, what="n_docs": F.sum(F.when(c, F.col(what)).otherwise(0))
    out = each.groupBy(*by, "rule_at").agg(
        count(bits.bitwiseAND(bit) != 0).alias("n_failed"), count(removed(bits, policy)).alias("n_removed"),
        count(sole).alias("n_sole"), count(sole, "n_words").alias("words_sole"), F.bit_or("failures").alias("any"), F.bit_and("failures").alias("all"),
    )
    names = lambda c: F.concat_ws(",", *[F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, F.lit(r)) for i, r in enumerate(RULES)])
    rule = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule_at") + 1)
    return out.select(*by, F.lit(version).alias("version"), rule.alias("rule"), "n_failed", "n_removed", "n_sole", "words_sole", names("any").alias("ever_failed"), names("all").alias("always_failed"))


def changes(entries: DataFrame, old: str, new: str, *by: str) -> DataFrame:
    """by, lost, gained, kept, removed: documents by what two versions say of them."""
    a, b = removed(F.col("failures"), POLICIES[old]), removed(F.col("failures"), POLICIES[new])
    count = lambda c: F.sum(F.when(c, F.col("n_docs")).otherwise(0))
    found = patterns(entries, *by).groupBy(*by) if by else patterns(entries)
    return found.agg(count(~a & b).alias("lost"), count(a & ~b).alias("gained"), count(~a & ~b).alias("kept"), count(a & b).alias("removed"))
