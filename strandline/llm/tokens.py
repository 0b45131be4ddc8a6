"""Token ids of whole texts by a public tokenizer, each distinct chunk of text encoded once.

Both pre-tokenizers used here never join what stands on two sides of the start of a white-space run, nor
ASCII letters, digits and other signs, so a text's ids are those of its pieces, one after another. Pieces
repeat a lot; a worker keeps their ids in flat arrays under a 64-bit hash, up to CACHE_CHUNKS of them, and
then starts afresh. New pieces go to the tokenizer in long strings, parted by a special token, as a call
for each costs more than the encoding itself.
"""

from __future__ import annotations

import re

import numpy as np

from strandline.llm.wordhash import TO_LOWER, piece_spans, span_hashes

CACHE_CHUNKS = 1_000_000
#: A text with a special token in it, or (where white space counts) white space outside ASCII, is one piece.
_SPECIAL = re.compile(rb"<\|")
_WHOLE = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    """Largest id and one."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


class ChunkEncoder:
    """name: a file of the public tokenizers. words: white space doesn't count and case of ASCII letters neither."""

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words = words
        self.part, self.part_id = max(((t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special), key=lambda x: x[1])
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.n, self.used = 0, 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of them."""
        if any(self.part in t for t in texts):
            new = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(new), np.fromiter(map(len, new), np.int64, len(new))
        joined = self.part.join(texts) + self.part
        ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        parts = np.flatnonzero(ids == self.part_id)
        if len(parts) != len(texts):
            raise ValueError("the parting token was lost")
        return np.delete(ids, parts), np.diff(parts, prepend=-1) - 1

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        flat, sizes = self._ids(texts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], flat, np.zeros(self.used // 2, np.uint32)])
        else:
            self.ids[self.used : self.used + len(flat)] = flat
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        pos = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, pos, keys)
        self.slot = np.insert(self.slot, pos, np.arange(self.n, self.n + len(keys)))
        self.n += len(keys)
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and each row's number of ids."""
        odd, raw, whole = _SPECIAL if self.words else _WHOLE, data.tobytes(), None
        if odd.search(raw):
            whole = np.array([bool(odd.search(raw, int(a), int(b))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        if self.words:
            lower = TO_LOWER[data]
            if whole is not None:  # special tokens count as they are written
                keep = np.repeat(whole, np.diff(offsets))
                lower[keep] = data[keep]
            data = lower
        starts, ends, rows = piece_spans(data, offsets, spaces=not self.words, whole_rows=whole)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.n > CACHE_CHUNKS:
            self.reset()
        pos = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        ok = pos < self.n
        known[ok] = self.keys[pos[ok]] == keys[ok]
        if not known.all():
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            self._learn(keys[new], [raw[a:b].decode("utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            pos = np.searchsorted(self.keys, keys)
        slot = self.slot[pos]
        begin, size = self.at[slot], (self.at[slot + 1] - self.at[slot])
        begin, size = begin[back], size[back]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        return flat, total[rows[1:]] - total[rows[:-1]]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, words: bool) -> ChunkEncoder:
    """This worker's encoder; workers live on between tasks."""
    if (path, words) not in _encoders:
        _encoders.clear()
        _encoders[path, words] = ChunkEncoder(path, words)
    return _encoders[path, words]
