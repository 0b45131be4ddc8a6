"""python -m strandline FILE... : what the files hold; with --to FORMAT --out DIR, the same in another format."""

from __future__ import annotations

import argparse

from strandline import __version__
from strandline.operators import stats
from strandline.session import get_session
from strandline.sources import reader, writers


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("--format", help="read all files as this format")
    p.add_argument("--to", help="write this format")
    p.add_argument("--out", help="folder to write to")
    p.add_argument("--pad", action="store_true", help="pad rows of unequal length")
    p.add_argument("--interleaved", action="store_true", help="blocks of all rows (PHYLIP, NEXUS, Stockholm)")
    p.add_argument("--crlf", action="store_true", help="end lines in CR LF")
    p.add_argument("--version", action="version", version=__version__)
    a = p.parse_args(argv)
    spark = get_session(master="local[*]")
    seqs = reader.read_sequences(spark, a.files, a.format)
    if a.to:
        layout = {"interleaved": True} if a.interleaved else {}
        writers.write(seqs, a.out or f"out-{a.to}", a.to, pad=a.pad, crlf=a.crlf, **layout)
    else:
        stats.shape(seqs).join(stats.alphabet_guess(seqs), "aln_id").orderBy("aln_id").show(1000, truncate=False)


if __name__ == "__main__":
    main()
