"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is filled with whole training texts (a bounded number
of rows). Every whole text, in lower case, is encoded with each dictionary in chunks of CHUNK bytes (in a
long text its own beginning would otherwise become the better dictionary); the smallest sum names the
language. The margin to the second smallest, as a share of the smallest, says how sure that is, and a
narrow margin rejects. What is narrow is learned from training rows that are in no dictionary: their
margins, and those they have when the dictionary of their own language is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import extended, packed, prepare

UNKNOWN = "und"
#: Bounds of the sample, in rows for each language: texts of a dictionary, and texts that set the least margin.
SAMPLE_TEXTS, MARGIN_TEXTS = 200, 100
#: Bytes that are encoded at once.
CHUNK = 1024
#: Shares of right margins, and of margins of left-out languages, that may lie under the least one.
MOST_REJECTED, MOST_LEFT_OUT = 0.01, 0.95
RESULTS = ("lang_pred", "lang_score", "lang_margin", "lang_share", "rejected")
_WORD = re.compile(rb"[^\s]+")


def has_letter(text: str | None) -> bool:
    """Whether any character is alphabetic (Unicode categories L*)."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Dictionary contents by language, the most frequent language first, and the margin (share) at or below which a text is rejected."""

    contents: dict[str, bytes] = field(default_factory=dict)
    least_share: float = 0.0


class Sizes:
    """Encoded sizes of a text under each dictionary; where asked for, also without one, as `und`."""

    def __init__(self, contents: dict[str, bytes], without: bool):
        import zstandard as z

        contents = contents | ({UNKNOWN: b"\n"} if without else {})
        self.langs = list(contents)
        self.by = []
        for c in contents.values():
            window = max(20, min(27, (len(c) + CHUNK).bit_length()))
            how = z.ZstdCompressionParameters(window_log=window, chain_log=18, hash_log=18, search_log=4, min_match=5, target_length=32, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(c or b"\n", dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.by.append(z.ZstdCompressor(compression_params=how, dict_data=d))

    def __call__(self, text: bytes) -> list[int]:
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.by]


def normal(text: str) -> bytes:
    return text.lower().encode()


def _share(sizes: list[int]) -> float:
    a, b = sorted(sizes)[:2]
    return (b - a) / a


def least_share(contents: dict[str, bytes], rows: list[tuple[str, str]]) -> float:
    """The least margin, from texts that are in no dictionary and their languages.

    MOST_LEFT_OUT of the margins of left-out languages lie under it, and of the right margins of learned
    ones at most MOST_REJECTED do, which goes first. With one or two languages none can be left out;
    half of what all but MOST_REJECTED right margins exceed is taken then.
    """
    sizes = Sizes(contents, without=True)
    right, left_out = [], []
    many = len(contents) > 1
    for text, lang in rows:
        if has_letter(text) and lang in contents:
            n = dict(zip(sizes.langs, sizes(normal(text)), strict=True))
            bare = n.pop(UNKNOWN)
            if many and min(n, key=lambda k: n[k]) == lang:
                right.append(_share(list(n.values())))
            elif not many and n[lang] < bare:
                right.append(_share([n[lang], bare]))
            n.pop(lang)
            if len(n) > 1:
                left_out.append(_share(list(n.values())))
    if not right:
        return 0.0
    high = float(np.quantile(right, MOST_REJECTED))
    return min(high, float(np.quantile(left_out, MOST_LEFT_OUT))) if left_out else high / 2


def fit(training: DataFrame, texts: int = SAMPLE_TEXTS, margin_texts: int = MARGIN_TEXTS) -> Model:
    """The model of training (text, lang): whole texts of `texts` rows for each language, chosen by hash, and the least margin from the next ones.

    Each text is taken once for a language; null texts and languages are left out. No rows give no languages.
    Ties of hashes go by the text.
    """
    prepare(training.sparkSession)
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return Model()
    wanted = texts + margin_texts
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 8 * wanted / n))])
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)
    few = rows.where(unit < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    found: dict[str, list[bytes]] = {}
    rest = []
    for r in few.withColumn("_r", rank).where(F.col("_r") <= wanted).select("lang", "text", "_r").orderBy("lang", "_r").toLocalIterator():
        own = found.setdefault(r["lang"], [])
        if len(own) < texts and (r["_r"] % 3 or margin_texts == 0):  # every third text sets the margin, also where there are few
            own.append(normal(r["text"]))
        else:
            rest.append((r["text"], r["lang"]))
    contents = {k: b"\n".join(found[k]) for k in sorted(found, key=lambda k: (-counts[k], k))}
    return Model(contents, least_share(contents, rest))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) plus lang_pred, lang_score (0 to 1), lang_margin (bytes), lang_share (of the smallest size) and rejected.

    `und`, with score 0, no margin and rejected: null texts, texts without a letter, and all texts where no language was
    learned. A text with a narrow margin keeps its language and is rejected, as is one that the only learned language makes no
    smaller (score 0, no margin). The score is share / (share + least share): one half at the learned bound. Of equal sizes those of single words decide; the margin is under 1 then, and the share 0. Ties that
    are left go to the language that was more frequent in training. Repeated rows have equal results, no rows
    give none. Other columns stay as they are, but for those with the name of a result.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(*RESULTS)
    rows, unpack = packed(docs, "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = Sizes(m.contents, without=len(m.contents) == 1)
        for b in batches:
            pred, margin, share = [], [], []
            for t in b.column("text").to_pylist():
                if not m.contents or not has_letter(t):
                    pred.append(UNKNOWN), margin.append(None), share.append(None)
                    continue
                text = normal(t)
                n = sizes(text)
                order = sorted(range(len(n)), key=lambda i: n[i])
                gap = float(n[order[1]] - n[order[0]])
                part = gap / n[order[0]]
                if gap == 0:  # the same sizes: those of the words one by one decide
                    tied = [i for i in order if n[i] == n[order[0]]]
                    alone = np.sum([sizes(b" " + w + b" ") for w in dict.fromkeys(_WORD.findall(text))], axis=0)
                    tied.sort(key=lambda i: alone[i])
                    order, gap = tied, float(alone[tied[1]] - alone[tied[0]]) / (1 + float(alone.max()))
                known = sizes.langs[order[0]] != UNKNOWN
                pred.append(sizes.langs[order[0]] if known else next(iter(m.contents)))
                margin.append(gap if known else None)
                share.append(part if known else None)
            score = np.array([x / (x + m.least_share) if x else 0.0 for x in share])
            out = [x is None or x <= m.least_share for x in share]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(margin, pa.float64()), pa.array(share, pa.float64()), pa.array(out, pa.bool_())], [*b.schema.names, *RESULTS])

    out = rows.mapInArrow(kernel, extended(rows, "lang_pred string, lang_score double, lang_margin double, lang_share double, rejected boolean"))
    return out.select(*unpack(out), *RESULTS)


def rejected() -> Column:
    """Rows of identify() that name no language, or do so too narrowly."""
    return F.col("rejected")
