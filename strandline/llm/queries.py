"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import crc_mod, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.decontamination import decontaminate

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text")).drop("text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM gram g JOIN win USING (n, phrase)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
""".replace("\\\\", "\\")


def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.privacy import find

    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("all_spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    known = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = fit(docs.select("doc_id", "text"), known)
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    places = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).alias("predicted"), places.alias("offending"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.langmodel import score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs.select("doc_id", "text"), crc_mod(F.col("doc_id"), 7) == 2)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.idstore import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), "rejected")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.ctph import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality import judge, ledger

    out = judge(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*first, "failures", "sole_rule", "n_lines", "n_letter_words", "n_bullet_lines", "n_cut_lines")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_letter_words,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[*•-]'))) AS BIGINT) AS n_bullet_lines,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_cut_lines
      FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN n_words > 100000 THEN 4 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 64 ELSE 0 END + CASE WHEN 100 * n_letter_words < 80 * n_words THEN 128 ELSE 0 END
             + CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 256 ELSE 0 END + CASE WHEN 100 * n_cut_lines > 30 * n_lines THEN 512 ELSE 0 END AS BIGINT) AS failures FROM m),
v AS (SELECT *, bit_count(failures & 187) AS hard, bit_count(failures & 832) AS soft FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, hard = 0 AND soft <= 1 AS kept, failures,
       CASE WHEN hard = 1 AND soft <= 1 THEN CASE failures & 187 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 8 THEN 'short_words' WHEN 16 THEN 'long_words' WHEN 32 THEN 'symbols' ELSE 'few_letters' END END AS sole_rule,
       n_lines, n_letter_words, n_bullet_lines, n_cut_lines
FROM v
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.negatives import hard_negatives, whole_numbers

    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(whole_numbers(rows), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.merkle import RESULTS, lowered, manifest

    return manifest(table(spark, sf_dir, "documents"), lowered(F.col("text"), F.col("doc_id"))).select(*RESULTS)


def _tree_sql(name: str, levels: int = 8) -> str:
    """Common tables that fold the nodes of {name}_0 (tree, place, pos, n, h, p) level by level until a tree has one: `place` is the leaf's
    place, `pos` that of its node, h the node's digest, p the siblings so far ([left, right] each). At most 16^levels leaves a tree."""
    out = []
    for k in range(levels):
        out.append(f"""{name}_g{k} AS (SELECT tree, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM (SELECT DISTINCT tree, pos, h FROM {name}_{k} WHERE n > 1) GROUP BY ALL),
{name}_{k + 1} AS (SELECT a.tree, place, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(hs) AS h, list_append(p, [hs[1:64 * (pos % 16)], hs[64 * (pos % 16) + 65:]]) AS p
  FROM {name}_{k} a JOIN {name}_g{k} g ON a.tree = g.tree AND a.pos // 16 = g.run WHERE n > 1 UNION ALL SELECT tree, place, pos, n, h, p FROM {name}_{k} WHERE n = 1)""")
    return ",\n".join(out)


def _op13_sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = ", ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
    folds = ",\n".join(f"f{k} AS (SELECT * EXCLUDE (f), CASE WHEN len(p) >= {k} THEN sha256(concat(p[{k}][1], f, p[{k}][2])) ELSE f END AS f FROM f{k - 1})" for k in range(1, 17))
    return f"""
WITH d AS (SELECT doc_id, source, sha256(concat({head}, {part("text")})) AS leaf, sha256(concat({head}, {part(low)})) AS changed, {crc} % 5 = 0 AS tampered FROM documents),
s AS (SELECT source, n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT source, count(*) AS n FROM d GROUP BY 1)),
w_0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS place, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS pos, n, leaf AS h,
  CAST([] AS VARCHAR[][]) AS p, doc_id, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS start FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t_0 AS (SELECT tree, place, pos, n, h, p FROM w_0), {_tree_sql("t")},
u_0 AS (SELECT CAST(0 AS BIGINT) AS tree, tree AS place, tree AS pos, count(*) OVER () AS n, h, CAST([] AS VARCHAR[][]) AS p FROM (SELECT DISTINCT tree, h FROM t_8)), {_tree_sql("u")},
f0 AS (SELECT w_0.doc_id, w_0.leaf, t_8.h AS subroot, u_8.h AS root, list_concat(t_8.p, u_8.p) AS p, w_0.start AS f FROM w_0 JOIN t_8 USING (tree, place) JOIN u_8 ON u_8.place = w_0.tree),
{folds}
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: concat(x[1], x[2])), '')) AS proof_sha256, f AS folded_root, f = root AS verified FROM f16
"""


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_privacy, op3_toxicity, op4_sharding, op5_lm_scores, op6_token_ids, op7_neardup, op8_langid, op9_fingerprints, op10_packing, op11_quality, op12_negatives, op13_merkle)}
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op11_quality": OP11_SQL, "op12_negatives": OP12_SQL, "op13_merkle": _op13_sql()}
