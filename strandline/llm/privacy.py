"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Four base recognisers (email, ip, card, phone) give spans that always stay. Looser scans propose more
candidates. On each, base and proposed, five labelers vote yes, no or nothing, each by a source of its own:
`form` (patterns of customary groupings), `checksum` (arithmetic of the digits), `gazetteer` (public lists),
`cue` (words before it) and `border` (the signs beside it). The whole corpus is summed up by counts of
(kind, votes), at most 4 * 3^5 rows. Expectation-maximisation over them estimates how reliable each labeler
is for each kind (Dawid and Skene). A logistic span classifier learns its posteriors from the votes and from
what no labeler reads: words on both sides and the span's shape of digits. It decides on the proposed ones.

All scans are linear in the text, and no span, run or text has a largest length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, prepare

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "checksum", "gazetteer", "cue", "border")
#: The probability from which the classifier adds a span that more labelers favour than reject.
ACCEPT = 0.9
#: Candidates that the classifier is trained on (those with the smallest hashes), and its hash buckets.
SAMPLE_SPANS, BUCKETS = 20_000, 2_048

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\(?[0-9]+\)?(?:[ .-]?\(?[0-9]+\)?)*")
_AT = re.compile(r" ?[(\[{]at[)\]}] ?| at (?=[A-Za-z0-9-]+ dot )", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]+)+", re.I)
_GROUPS = {
    "card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(\1\d{3})?|\d{4}([ -])\d{6}\3\d{4,5}"),
    "phone": re.compile(r"\+.*|00[1-9][0-9 ().-]*|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4}|\(?0\d{1,4}\)?[ -]\d[0-9 -]{4,}"),
}
_DATE = re.compile(r"(19|20)\d\d([-. ])(0?[1-9]|1[0-2])\2(0?[1-9]|[12]\d|3[01])\b|(0?[1-9]|[12]\d|3[01])([-.])(0?[1-9]|1[0-2])\6(19|20)\d\d\b")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[A-Za-z]+$")

#: Generic top-level domains and the country domains with most names.
TOP_LEVEL = frozenset(
    """com org net edu gov mil int info biz name pro mobi app dev io ai co me tv cc xyz online site shop store club top example
    ac ae ar at au be bg bo br by ca ch cl cn cr cy cz de dk do ec ee eg es eu fi fr ge gr gt hk hr hu id ie il in ir is it jp ke kr kz lk lt lu
    lv ma md mk mt mx my ng nl no np nz pe ph pk pl pr pt py qa ro rs ru sa se sg si sk su th tn tr tw ua ug uk us uy uz ve vn za""".split()
)
#: Issuer ranges of card numbers (first digits from, to) and the lengths that go with them.
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "649", (16, 19)), ("65", "65", (16, 19)),
    ("3528", "3589", (16, 17, 18, 19)), ("300", "305", (14, 16, 19)), ("36", "36", (14, 16, 19)), ("38", "39", (14, 16, 19)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (13, 16, 19)), ("56", "58", (13, 16, 19)),
)
#: Reserved blocks of addresses (first parts) that belong to nobody's host.
RESERVED = ("0.", "127.", "192.0.2.", "198.51.100.", "203.0.113.", "255.", *(f"{i}." for i in range(224, 255)))
#: Country calling codes with the lengths of numbers behind them (least, most digits).
CALLING = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (4, 13), "44": (7, 10),
    "45": (8, 8), "46": (7, 13), "47": (5, 8), "48": (9, 9), "49": (6, 13), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (8, 10), "58": (10, 10), "60": (7, 10), "61": (9, 9), "62": (7, 12),
    "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (8, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "94": (9, 9), "98": (10, 10), "212": (9, 9),
    "213": (8, 9), "216": (8, 8), "234": (8, 10), "254": (9, 10), "351": (9, 9), "352": (4, 11), "353": (7, 9), "354": (7, 9), "358": (5, 12), "359": (7, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "375": (9, 9),
    "380": (9, 9), "381": (8, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "961": (7, 8), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}
#: Beginnings of words that speak for a kind, and against all.
CUES = {
    "email": ("mail", "email", "contact", "write", "kontakt", "courriel", "correo", "reach"),
    "ip": ("ip", "host", "address", "server", "client", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial", "telefon", "appel", "ruf"),
}
AGAINST = ("version", "order", "invoice", "token", "sha", "isbn", "serial", "hash", "issue", "figure", "ref", "id", "date", "part")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _octet(part: str) -> bool:
    """Whether a run of digits is at most 255, whatever zeros lead it."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """Matches of [0-9]+(\\.[0-9]+){3}, found in whole chains of dotted numbers, and whether all parts are at most 255."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                yield at, end, all(map(_octet, four))
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start, in code points."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, a, b) for a, b, ok in _ips(text) if ok]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def proposed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser scans that meet no base span: spelled-out addresses, and digit groups parted by single signs."""
    out, done = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _SPELLED.match(text, m.end()) if start < m.start() else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() < 7 or (m.start() and text[m.start() - 1] == "+"):
                continue
            span = m[0].rstrip(")") if m[0].count(")") > m[0].count("(") or m[0].endswith(")") else m[0]
            lead = 1 if span.startswith("(") and ")" not in span else 0
            n = len(_DIGIT.findall(span))
            if 7 <= n <= 19:
                chain = span[lead:].split(".")
                kind = 1 if len(chain) == 4 and all(p.isascii() and p.isdigit() for p in chain) else 2 if n >= 13 else 3
                out.append((kind, m.start() + lead, m.start() + len(span)))
    taken, i, free = sorted((a, b) for _, a, b in base), 0, []
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for k, a, b in sorted(out, key=lambda s: s[1]):
        while i < len(taken) and taken[i][0] < b:
            i += 1  # taken[:i] begin before b; the furthest of them ends at reach[i - 1]
        if not i or reach[i - 1] <= a:
            free.append((k, a, b))
    return free


def _issuer(digits: str) -> bool:
    return any(lo <= digits[: len(lo)] <= hi and len(digits) in sizes for lo, hi, sizes in ISSUERS)


def _caller(span: str, digits: str) -> int:
    """+1 where a listed country code and length fit, -1 where they don't, 0 where no list says so."""
    if span.startswith("+") or digits.startswith("00"):
        own = digits.removeprefix("00") if digits.startswith("00") else digits
        for n in (3, 2, 1):
            if own[:n] in CALLING:
                lo, hi = CALLING[own[:n]]
                return 1 if lo <= len(own) - n <= hi else -1
        return 0
    if len(digits) == 10 and not digits.startswith("0"):
        return 1 if digits[0] > "1" and digits[3] > "1" else -1
    return 0


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, int, int, int, int]:
    """1, -1 or 0 by each of LABELERS."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span)) if kind else ""
    form = checksum = gazetteer = 0
    if kind == 0:
        form = -1 if " at " in span.lower() else 1
        gazetteer = 1 if (m := _END.search(span.lower())) and m[0] in TOP_LEVEL else -1
    elif kind == 1:
        parts = span.split(".")
        form = 1 if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in parts) else -1
        checksum = 1 if all(map(_octet, parts)) else -1
        gazetteer = -1 if span.startswith(RESERVED) else 1 if parts[0] else 0
    elif kind == 2:
        form = 1 if _GROUPS["card"].fullmatch(span) else -1
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if _issuer(digits) else -1
    else:
        form = 1 if _GROUPS["phone"].fullmatch(span) else -1
        checksum = -1 if len(set(digits)) == 1 or _DATE.match(span) else 0
        gazetteer = _caller(span, digits)
    before = _WORD.findall(around(text, start, end)[0])[-4:]
    cue = 1 if any(w.startswith(CUES[KINDS[kind]]) for w in before) else -1 if any(w.startswith(AGAINST) for w in before) else 0
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() or c in "\"'=_/#" for c in sides) else 1
    return (form, checksum, gazetteer, cue, border)


def around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and after a span, in lower case: 40 characters, and on to the end of a word that they cut."""
    lo, hi = max(0, start - 40), min(len(text), end + 40)
    while lo > 0 and lo < start and text[lo].isalpha() and text[lo - 1].isalpha():
        lo -= 1
    while hi < len(text) and hi > end and text[hi - 1].isalpha() and text[hi].isalpha():
        hi += 1
    return text[lo:start].lower(), text[end:hi].lower()


def code(vote: tuple[int, ...]) -> int:
    n = 0
    for v in vote:
        n = 3 * n + v + 1
    return n


def decode(n: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        n, v = divmod(n, 3)
        out.append(v - 1)
    return tuple(reversed(out))


_N_VOTES = len(KINDS) * (1 + 2 * len(LABELERS))
WIDTH = _N_VOTES + BUCKETS


def features(text: str, kind: int, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Places of a candidate's features: its kind and votes, and hashed: two words on each side, its shape of digits."""
    at = kind * (1 + 2 * len(LABELERS))
    out = [at] + [at + 1 + 2 * j + (v > 0) for j, v in enumerate(vote) if v]
    runs = re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", text[start:end]) if kind else ""
    left, right = around(text, start, end)
    said = [f"b{w}" for w in _WORD.findall(left)[-2:]] + [f"a{w}" for w in _WORD.findall(right)[:2]]
    return out + sorted({_N_VOTES + zlib.crc32(f"{kind}{x}".encode()) % BUCKETS for x in [f"s{runs}", *said]})


def extract(docs: DataFrame) -> DataFrame:
    """doc_id and all candidates (kind, start, end, base, votes, at) of docs (doc_id, text; null text: empty)."""
    prepare(docs.sparkSession)
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("at", pa.list_(pa.int32()))])

    def found(text: str | None) -> list[dict]:
        out = []
        if text:
            base = base_spans(text)
            for is_base, spans in ((True, base), (False, proposed_spans(text, base))):
                for k, a, b in spans:
                    v = votes(text, k, a, b)
                    out.append({"kind": k, "start": a, "end": b, "base": is_base, "votes": code(v), "at": features(text, k, a, b, v)})
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([found(t) for t in b.column("text").to_pylist()], pa.list_(item))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, spans array<struct<kind:int, start:int, end:int, base:boolean, votes:int, at:array<int>>>")


def reliabilities(kinds: np.ndarray, vote: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns. Posterior of each pattern, and theta[kind, class, labeler, vote + 1].

    It starts from the share of yes votes, and Beta-like counts keep unseen votes possible.
    """
    cast = (vote != 0).sum(1)
    post = np.clip((vote == 1).sum(1) / np.maximum(cast, 1), 0.05, 0.95)
    theta = np.zeros((len(KINDS), 2, vote.shape[1], 3))
    for _ in range(rounds):
        score = np.zeros((len(counts), 2))
        for k in range(len(KINDS)):
            own = kinds == k
            for c, p in enumerate((1 - post, post)):
                w = (p * counts)[own]
                score[own, c] = np.log((w.sum() + 1) / (counts[own].sum() + 2))
                for j in range(vote.shape[1]):
                    n = np.array([w[vote[own, j] == v].sum() for v in (-1, 0, 1)])
                    # a labeler is trusted a little beforehand: yes for real spans, no for others
                    theta[k, c, j] = (n + ((1, 1, 4) if c else (4, 1, 1))) / (n.sum() + 6)
                    score[own, c] += np.log(theta[k, c, j][vote[own, j] + 1])
        post = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    return post, theta


class Classifier:
    """A logistic model over places of features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def adds(self, at: list[int]) -> bool:
        """Whether a proposed span is added: it is likely."""
        return float(self.bias + self.weights[at].sum()) >= np.log(ACCEPT / (1 - ACCEPT))


def train(rows: list[list[int]], target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> Classifier:
    """Full-batch AdaGrad on the logistic likelihood of soft targets."""
    n = len(rows)
    flat = np.fromiter((x for r in rows for x in r), np.int64)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    w, b = np.zeros(WIDTH), 0.0
    gw, gb = np.full(WIDTH, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(of, w[flat], n), -30, 30)))
        miss = (target - p) / n
        g = np.bincount(flat, miss[of], WIDTH) - ridge * w
        gw += g * g
        w += 0.5 * g / np.sqrt(gw)
        gb += miss.sum() ** 2
        b += 0.5 * miss.sum() / np.sqrt(gb)
    return Classifier(w, b)


def fit(candidates: DataFrame) -> Classifier:
    """The span classifier, trained on the posteriors; candidates: of extract(), stored. Votes are summed up over all of them."""
    spans = candidates.select("doc_id", F.explode("spans").alias("s"))
    counts = spans.groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3^5 rows
    if not counts:
        return Classifier(np.zeros(WIDTH), -30.0)
    counts.sort()
    kinds, vote, n = (np.array(x) for x in ([r["kind"] for r in counts], [decode(r["votes"]) for r in counts], [float(r["n"]) for r in counts]))
    post, _ = reliabilities(kinds, vote, n)
    of = {(r["kind"], r["votes"]): p for r, p in zip(counts, post.tolist(), strict=True)}
    place = F.xxhash64("doc_id", "s.start", "s.kind")
    share = min(1.0, 4 * SAMPLE_SPANS / n.sum())
    few = spans.where(F.pmod(place, F.lit(1 << 20)) <= share * (1 << 20)).orderBy(place, "s.at").limit(SAMPLE_SPANS).select("s.kind", "s.votes", "s.at").collect()
    return train([r["at"] for r in few], np.array([of[r["kind"], r["votes"]] for r in few]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (text form of all), all_spans (array).

    A null or empty text has no spans; no rows give no rows; repeated rows and ids are treated alike, each
    on its own. Ties: spans of one kind are listed by start; base ones of two kinds may overlap and both
    stay. Only doc_id and text are read, so further columns of any name don't matter.
    """
    with Workspace(docs.sparkSession, "pii") as work:
        candidates = work.store(extract(docs), "candidates")
        shared = docs.sparkSession.sparkContext.broadcast(fit(candidates))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
                digest, every, listed = [], [], []
                for i, spans in enumerate(batch.column("spans").to_pylist()):
                    spans.sort(key=lambda s: (s["kind"], s["start"]))
                    text = lambda s: f"{KINDS[s['kind']]}:{s['start']}:{s['end']}"
                    base = [s for s in spans if s["base"]]
                    for s in base:
                        counts[i, s["kind"]] += 1
                    kept = [s for s in spans if s["base"] or model.adds(s["at"])]
                    digest.append(hashlib.sha256(",".join(map(text, base)).encode()).hexdigest())
                    every.append(",".join(map(text, kept)))
                    listed.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"]} for s in kept])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts.T.copy()), pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(listed, item)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "all_spans"])

        found = candidates.mapInArrow(kernel, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, all_spans array<struct<kind:string, start:int, end:int>>")
        return keep(found, "pii-found")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text put as <KIND>; the model is fitted on docs. All other columns stay as they are.

    Spans that overlap are merged under the name of the first, of equal starts the longest. A null text
    stays null, an empty one empty; repeated rows and null ids are treated each on its own; no rows give none.
    """
    spark = docs.sparkSession
    with Workspace(spark, "pii") as work:
        shared = spark.sparkContext.broadcast(fit(work.store(extract(docs.select("doc_id", "text")), "candidates")))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        model, base = shared.value, base_spans(text)
        spans = list(base)
        for k, a, b in proposed_spans(text, base):
            v = votes(text, k, a, b)
            if model.adds(features(text, k, a, b, v)):
                spans.append((k, a, b))
        out, done = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"<{KINDS[k].upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]]) if spans else text

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(kernel, docs.schema)
