"""Parsers of sequence formats: bytes in, records out. One file is one alignment."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from strandline.errors import FormatError, ParseError

#: Formats and their extensions; the first format of a shared extension wins.
EXTENSIONS = {
    "fasta": ("fasta", "fa", "fas", "fna", "faa", "ffn", "frn", "mpfa"),
    "fastq": ("fastq", "fq"),
    "phylip": ("phy", "ph", "phylip"),
    "phylip-relaxed": ("phy", "ph", "phylip"),
    "nexus": ("nex", "nexus", "nxs"),
    "clustal": ("aln", "clustal", "clw"),
    "stockholm": ("sto", "stk", "stockholm"),
    "msf": ("msf",),
    "genbank": ("gb", "gbk", "genbank"),
}
READ_ONLY = ("msf", "genbank")


@dataclass
class Record:
    id: str
    residues: str
    description: str = ""
    quality: list[int] | None = None


@dataclass
class Parsed:
    records: list[Record]
    alphabet: str | None = None
    format: str = ""


def decode(data: bytes) -> str:
    return data.decode("utf-8-sig", errors="replace")


def _lines(text: str) -> list[tuple[int, str]]:
    return list(enumerate(text.splitlines(), 1))


def _residues(s: str) -> str:
    """Without white space and digits."""
    return re.sub(r"[\s0-9]", "", s)


def _clean(s: str) -> str:
    return s.replace(".", "-").replace("~", "-")


def _split_header(h: str) -> tuple[str, str]:
    parts = h.strip().split(None, 1)
    return (parts[0] if parts else "", parts[1].strip() if len(parts) > 1 else "")


def format_of_path(path: str) -> str | None:
    name = PurePosixPath(path).name.lower()
    if name.endswith(".txt") and "." in name[:-4]:
        name = name[:-4]
    ext = name.rpartition(".")[2] if "." in name else ""
    return next((f for f, es in EXTENSIONS.items() if ext in es), None)


def _phylip_header(line: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\s*(\d+)\s+(\d+)\s*", line)
    return (int(m[1]), int(m[2])) if m else None


def sniff(data: bytes) -> str | None:
    """The format by content: the first 64 KiB, blank lines at the start skipped, twelve lines."""
    lines = [x for x in decode(data[:65536]).lstrip().splitlines()[:12]]
    if not lines:
        return None
    first = lines[0].strip()
    up = first.upper()
    if up.startswith("#NEXUS"):
        return "nexus"
    if up.startswith("# STOCKHOLM"):
        return "stockholm"
    if "CLUSTAL" in up:
        return "clustal"
    if up.startswith("LOCUS"):
        return "genbank"
    if up.startswith("!!") or up.startswith("PILEUP") or any("MSF:" in x.upper() for x in lines):
        return "msf"
    if first.startswith(">") or first.startswith(";") and any(x.startswith(">") for x in lines):
        return "fasta"
    if first.startswith("@") and any(x.startswith("+") for x in lines[1:7]):
        return "fastq"
    if _phylip_header(first):
        row = lines[1] if len(lines) > 1 else ""
        token = row.split()[0] if row.split() else ""
        strict = len(row) > 10 and len(token) <= 10 and not (row[9:10].strip() and row[10:11].strip())
        return "phylip" if strict else "phylip-relaxed"
    return None


def parse_fasta(text: str) -> list[Record]:
    out: list[Record] = []
    body: list[list[str]] = []
    for n, line in _lines(text):
        line = line.strip()
        if not line or line.startswith(";"):
            continue
        if line.startswith(">"):
            out.append(Record(_split_header(line[1:])[0], "", _split_header(line[1:])[1]))
            body.append([])
        elif not out:
            raise ParseError("FASTA", n, "sequence data before the first header")
        else:
            body[-1].append(_residues(line))
    if not out:
        raise ParseError("FASTA", 1, "no header line")
    for r, b in zip(out, body, strict=True):
        r.residues = _clean("".join(b))
    return out


def parse_fastq(text: str) -> list[Record]:
    lines, i = _lines(text), 0
    raw: list[tuple[str, str, str]] = []
    while i < len(lines):
        n, line = lines[i]
        if not line.strip():
            i += 1
            continue
        if not line.startswith("@"):
            raise ParseError("FASTQ", n, "a record must start with '@'")
        head, seq, qual = line[1:], "", ""
        i += 1
        while i < len(lines) and not lines[i][1].startswith("+"):
            seq += _residues(lines[i][1])
            i += 1
        if i == len(lines):
            raise ParseError("FASTQ", n, "no '+' line")
        i += 1
        while i < len(lines) and len(qual) < len(seq):
            qual += lines[i][1].strip()
            i += 1
        if len(qual) != len(seq):
            raise ParseError("FASTQ", n, f"{len(seq)} residues but {len(qual)} scores")
        raw.append((head, seq, qual))
    marks = "".join(q for _, _, q in raw)
    offset = 64 if marks and max(marks) > "J" and min(marks) >= ";" else 33
    return [Record(*(_split_header(h)[0], _clean(s), _split_header(h)[1]), [max(0, ord(c) - offset) for c in q]) for h, s, q in raw]


def _phylip_name(line: str, strict: bool) -> tuple[str, str]:
    if strict:
        return line[:10].strip(), line[10:]
    parts = line.strip().split(None, 1)
    return parts[0], parts[1] if len(parts) > 1 else ""


def parse_phylip(text: str, strict: bool) -> list[Record]:
    lines = [(n, x) for n, x in _lines(text) if x.strip()]
    dims = _phylip_header(lines[0][1]) if lines else None
    if not dims:
        raise ParseError("PHYLIP", lines[0][0] if lines else 1, "the first line must hold two numbers")
    ntax, nchar = dims
    data = lines[1:]
    if ntax == 0:
        return []

    def sequential() -> list[tuple[str, str]]:
        rows, i = [], 0
        for _ in range(ntax):
            if i >= len(data):
                raise ParseError("PHYLIP", lines[-1][0], f"{len(rows)} of {ntax} sequences")
            start = data[i][0]
            name, rest = _phylip_name(data[i][1], strict)
            seq = _residues(rest)
            i += 1
            while len(seq) < nchar and i < len(data):
                seq += _residues(data[i][1])
                i += 1
            if len(seq) != nchar:
                raise ParseError("PHYLIP", start, f"{name}: {len(seq)} of {nchar} residues")
            rows.append((name, seq))
        if i < len(data):
            raise ParseError("PHYLIP", data[i][0], "data after the last sequence")
        return rows

    def interleaved() -> list[tuple[str, str]]:
        if len(data) % ntax:
            raise ParseError("PHYLIP", lines[-1][0], f"blocks don't have {ntax} lines each")
        rows = [_phylip_name(x, strict) for _, x in data[:ntax]]
        names, seqs = [r[0] for r in rows], [_residues(r[1]) for r in rows]
        for i, (_, x) in enumerate(data[ntax:]):
            k = i % ntax
            head, _, rest = x.strip().partition(" ")
            seqs[k] += _residues(rest if head == names[k] and rest.strip() else x)
        for name, seq in zip(names, seqs, strict=True):
            if len(seq) != nchar:
                raise ParseError("PHYLIP", data[0][0], f"{name}: {len(seq)} of {nchar} residues")
        return list(zip(names, seqs, strict=True))

    whole = len(data) >= ntax and all(len(_residues(_phylip_name(x, strict)[1])) >= nchar for _, x in data[:ntax])
    if whole:
        rows = sequential()
    else:
        try:
            rows = interleaved()
        except ParseError as first:
            try:
                rows = sequential()
            except ParseError:
                raise first from None
    return [Record(n, _clean(s)) for n, s in rows]


@dataclass
class _Block:
    ntax: int | None = None
    nchar: int | None = None
    gap: str = "-"
    missing: str = "?"
    match: str | None = None
    interleave: bool = False
    alphabet: str | None = None
    rows: list[tuple[str, str]] = field(default_factory=list)


def _nexus_tokens(text: str) -> list[tuple[int, str, bool]]:
    """(line, token, quoted); comments are left out, ';' and '=' stand alone."""
    out, i, line, n = [], 0, 1, len(text)
    word, at = "", 1

    def flush() -> None:
        nonlocal word
        if word:
            out.append((at, word, False))
            word = ""

    while i < n:
        c = text[i]
        if c == "[":
            depth, start = 1, line
            i += 1
            while i < n and depth:
                depth += {"[": 1, "]": -1}.get(text[i], 0)
                line += text[i] == "\n"
                i += 1
            if depth:
                raise ParseError("NEXUS", start, "a comment isn't closed")
            continue
        if c == "'" and not word:
            start, quoted = line, ""
            i += 1
            while True:
                if i >= n:
                    raise ParseError("NEXUS", start, "a quote isn't closed")
                if text[i] == "'":
                    if text[i + 1 : i + 2] == "'":
                        quoted += "'"
                        i += 2
                        continue
                    break
                line += text[i] == "\n"
                quoted += text[i]
                i += 1
            out.append((start, quoted, True))
        elif c.isspace() or c in ";=":
            flush()
            if c in ";=":
                out.append((line, c, False))
            line += c == "\n"
        else:
            if not word:
                at = line
            word += c
        i += 1
    flush()
    return out


def parse_nexus(text: str) -> Parsed:
    toks = _nexus_tokens(text)
    if not toks or toks[0][1].upper() != "#NEXUS":
        raise ParseError("NEXUS", 1, "the file must start with #NEXUS")
    low = [("" if q else t.lower()) for _, t, q in toks]
    for i in range(1, len(toks) - 1):
        if low[i] == "begin" and (low[i + 1] == "data" or low[i + 1].startswith("characters")):
            return _nexus_block(toks, low, i + 2)
    raise ParseError("NEXUS", 1, "no data or characters block")


def _nexus_block(toks: list[tuple[int, str, bool]], low: list[str], i: int) -> Parsed:
    b = _Block()
    while i < len(toks) and low[i] not in ("end", "endblock"):
        end = next((j for j in range(i, len(toks)) if toks[j][1] == ";" and not toks[j][2]), len(toks))
        if low[i] in ("dimensions", "format"):
            words = toks[i + 1 : end]
            j = 0
            while j < len(words):
                key = words[j][1].lower()
                value = words[j + 2][1] if j + 2 < len(words) and words[j + 1][1] == "=" else None
                j += 3 if value is not None else 1
                if key in ("ntax", "nchar") and value:
                    setattr(b, key, int(value))
                elif key in ("gap", "missing") and value:
                    setattr(b, key, value[0])
                elif key == "matchchar" and value:
                    b.match = value[0]
                elif key == "interleave":
                    b.interleave = value is None or value.lower().startswith("y")
                elif key == "datatype" and value:
                    b.alphabet = {"dna": "DNA", "nucleotide": "DNA", "rna": "RNA", "protein": "protein", "aminoacid": "protein"}.get(value.lower())
        elif low[i] == "matrix":
            if end == len(toks):
                raise ParseError("NEXUS", toks[i][0], "the matrix isn't closed by ';'")
            _nexus_matrix(b, toks[i + 1 : end], toks[i][0])
        i = end + 1
    return Parsed([Record(n, s) for n, s in b.rows], b.alphabet)


def _nexus_matrix(b: _Block, toks: list[tuple[int, str, bool]], at: int) -> None:
    by_line: dict[int, list[str]] = {}
    for n, t, _ in toks:
        by_line.setdefault(n, []).append(t)
    lines = list(by_line.values())
    heads = [x[0] for x in lines if len(x) > 1]
    rows: dict[str, str] = {}
    if b.interleave or len(set(heads)) < len(heads):
        for x in lines:
            rows[x[0]] = rows.get(x[0], "") + "".join(x[1:])
    else:
        name = None
        for x in lines:
            if name is not None and b.nchar is not None and len(rows[name]) < b.nchar:
                rows[name] += "".join(x)
            else:
                name = x[0]
                rows[name] = "".join(x[1:])
    first = next(iter(rows.values()), "")
    for name, seq in rows.items():
        if b.match:
            seq = "".join(first[k] if c == b.match and k < len(first) else c for k, c in enumerate(seq))
        seq = seq.replace(b.missing, "\0").replace(b.gap, "-").replace("\0", "?")
        if b.nchar is not None and len(seq) != b.nchar:
            raise ParseError("NEXUS", at, f"{name}: {len(seq)} of {b.nchar} characters")
        b.rows.append((name, _clean(seq)))
    if b.ntax is not None and len(rows) != b.ntax:
        raise ParseError("NEXUS", at, f"{len(rows)} of {b.ntax} taxa")


def _conservation(line: str) -> bool:
    return bool(re.fullmatch(r"[ \t.:*]*[.:*][ \t.:*]*", line))


def _gather(rows: dict[str, list[str]], name: str, chunk: str) -> None:
    rows.setdefault(name, []).append(chunk)


def parse_clustal(text: str) -> list[Record]:
    rows: dict[str, list[str]] = {}
    lines = [(n, x) for n, x in _lines(text) if x.strip()]
    if lines and re.search("CLUSTAL|MULTIPLE SEQUENCE ALIGNMENT", lines[0][1].upper()):
        lines = lines[1:]
    for n, line in lines:
        if _conservation(line):
            continue
        parts = line.split()
        if len(parts) > 2 and parts[-1].isdigit():
            parts.pop()
        if len(parts) < 2:
            raise ParseError("Clustal", n, f"{parts[0]} has no residues")
        _gather(rows, parts[0], _residues("".join(parts[1:])))
    return [Record(k, _clean("".join(v))) for k, v in rows.items()]


def parse_stockholm(text: str) -> list[Record]:
    rows: dict[str, list[str]] = {}
    for n, line in _lines(text):
        if line.strip() == "//":
            break
        if not line.strip() or line.startswith("#"):
            continue
        parts = line.split()
        if len(parts) < 2:
            raise ParseError("Stockholm", n, f"{parts[0]} has no residues")
        _gather(rows, parts[0], "".join(parts[1:]))
    return [Record(k, _clean("".join(v))) for k, v in rows.items()]


def parse_msf(text: str) -> list[Record]:
    rows: dict[str, list[str]] = {}
    lines = _lines(text)
    split = next((i for i, (_, x) in enumerate(lines) if x.strip() == "//"), None)
    if split is None:
        raise ParseError("MSF", len(lines) or 1, "no '//' line")
    for _, line in lines[:split]:
        m = re.search(r"\bName:\s*(\S+)", line)
        if m:
            rows.setdefault(m[1], [])
    for _, line in lines[split + 1 :]:
        parts = line.split()
        if len(parts) > 1 and not all(p.isdigit() for p in parts):
            _gather(rows, parts[0], _residues("".join(parts[1:])))
    return [Record(k, _clean("".join(v))) for k, v in rows.items()]


def parse_genbank(text: str) -> list[Record]:
    out: list[Record] = []
    pieces: list[tuple[list[str], list[str]]] = []  # of each record: description, residues
    part = None
    for n, line in _lines(text):
        key = line[:12].strip()
        if line.startswith("LOCUS"):
            words = line.split()
            out.append(Record(words[1] if len(words) > 1 else "", ""))
            pieces.append(([], []))
            part = "head"
        elif line.startswith("//"):
            part = None
        elif not line.strip():
            continue
        elif part is None:
            raise ParseError("GenBank", n, "a record must start with LOCUS")
        elif line.startswith("DEFINITION"):
            pieces[-1][0][:], part = [line[12:].strip()], "definition"
        elif line.startswith("ORIGIN"):
            part = "origin"
        elif part == "origin":
            pieces[-1][1].append(_residues(line))
        elif part == "definition" and not key:
            pieces[-1][0].append(line.strip())
        else:
            part = "head"
    if not out:
        raise ParseError("GenBank", 1, "no LOCUS line")
    for r, (description, residues) in zip(out, pieces, strict=True):
        r.residues = _clean("".join(residues))
        r.description = " ".join(description).rstrip(".").strip() if description else r.description.rstrip(".").strip()
    return out


def parse(data: bytes, format: str) -> Parsed:
    """A strict PHYLIP file that fails is tried as a relaxed one, and the other way; the first error stands."""
    text = decode(data)
    if format in ("phylip", "phylip-relaxed"):
        strict = format == "phylip"
        try:
            return Parsed(parse_phylip(text, strict), None, format)
        except ParseError as first:
            try:
                return Parsed(parse_phylip(text, not strict), None, "phylip-relaxed" if strict else "phylip")
            except ParseError:
                raise first from None
    if format == "nexus":
        out = parse_nexus(text)
        out.format = format
        return out
    by = {"fasta": parse_fasta, "fastq": parse_fastq, "clustal": parse_clustal, "stockholm": parse_stockholm, "msf": parse_msf, "genbank": parse_genbank}
    if format not in by:
        raise FormatError(f"unknown format {format}")
    return Parsed(by[format](text), None, format)
