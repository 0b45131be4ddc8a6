"""Raw token-id files with a minimal perfect hash index over document keys.

Documents are dealt in ranges of ascending key to parts, and each part is written as shards. Under the
output folder:

    ids-PPPPP-SSSSS.bin      the ids of a shard's records, one after another, nothing else: little-endian unsigned, of
                             16 bits if the vocabulary has at most 2^16 ids, else of 32
    keys-PPPPP-SSSSS.bin     for scans: records and null keys (2 x u32), then the key (int64) and the number of ids (u32) of each record
    index-PPPPP.mph          the minimal perfect hash of the part's keys: key -> (shard, offset in it, ids)
    manifest/                a Parquet table of shards: part, seq, width (bytes of an id), base, n_ids, n_records, n_null, first_key, last_key

The hash is a cascade of bit sets: a key that is alone on its place in a level owns that bit, others go to
the next level. A key's slot is the number of set bits before its own, so slots are 0..n-1 without gaps;
the counts of bits are stored for every block of 512, so a lookup reads one block for each level it
passes (few keys pass three) and one entry. An entry holds a 32-bit fingerprint of its key; a key that isn't
there fails it but for one in 2^32. A keyed read thus costs some small reads at known places of the index
of one part (found by the parts' first keys), and the bytes of its ids, however large the corpus.

Files are written under a name of their own and then renamed; what a task writes depends on its rows
alone, so a task that runs again, or twice, leaves the same files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, keep, lots_of, prepare, row_blocks, text_buffer
from strandline.llm.tokens import encoder, tokenizer_path, vocabulary_size
from strandline.llm.wordhash import mix

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a shard is closed, be it between records of one key.
SHARD_IDS = 1 << 20
MANIFEST = "part int, seq int, width int, base long, n_ids long, n_records long, n_null long, first_key long, last_key long"
NAMES = [x.split()[0] for x in MANIFEST.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in MANIFEST.split(", ")]
#: Bits whose count is stored once, and an entry: fingerprint, shard, offset and ids of a key.
BLOCK = 512
ENTRY = np.dtype([("print", "<u4"), ("seq", "<u4"), ("offset", "<u8"), ("size", "<u8")])
_U = np.uint64


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.view(_U) + _U(0x9E3779B97F4A7C15) * _U(level + 1))


def _print(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 999) >> _U(32)).astype(np.uint32)


def build_index(keys: np.ndarray, seq: np.ndarray, offset: np.ndarray, size: np.ndarray) -> bytes:
    """keys: distinct int64; where the ids of each begin (shard, offset), and how many they are.

    Layout: number of keys (u64) and levels (u32), bits of each level (u64), then for each level its bits and
    the set bits before each block (u64, over all levels), then the entries.
    """
    left = np.arange(len(keys))
    levels: list[np.ndarray] = []
    slot = np.zeros(len(keys), np.int64)
    done = 0
    while len(left):
        m = max(BLOCK, -(-2 * len(left) // BLOCK) * BLOCK)
        at = (_level_hash(keys[left], len(levels)) % _U(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        own = alone[at]
        slot[left[own]] = done + np.cumsum(alone)[at[own]] - 1
        levels.append(alone)
        done += int(own.sum())
        left = left[~own]
    out, before = [struct.pack(f"<QI{len(levels)}Q", len(keys), len(levels), *map(len, levels))], 0
    for bits in levels:
        in_block = bits.reshape(-1, BLOCK).sum(1)
        out += [np.packbits(bits, bitorder="little").tobytes(), (before + np.cumsum(in_block) - in_block).astype("<u8").tobytes()]
        before += int(in_block.sum())
    entries = np.zeros(len(keys), ENTRY)
    entries["print"][slot], entries["seq"][slot], entries["offset"][slot], entries["size"][slot] = _print(keys), seq, offset, size
    return b"".join([*out, entries.tobytes()])


class Index:
    """Read side of build_index(), by reads of (place, bytes)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        self.n, n_levels = struct.unpack("<QI", read(0, 12))
        sizes = struct.unpack(f"<{n_levels}Q", read(12, 8 * n_levels))
        self.levels, at = [], 12 + 8 * n_levels
        for m in sizes:
            self.levels.append((m, at, at + m // 8))
            at += m // 8 + 8 * (m // BLOCK)
        self.entries, self.whole = at, None

    def find(self, key: int) -> tuple[int, int, int] | None:
        """Shard, offset and ids of one key, in a few small reads; None where it isn't in the index."""
        k = np.array([key], np.int64)
        for level, (m, bits_at, ranks_at) in enumerate(self.levels):
            place = int(_level_hash(k, level)[0] % _U(m))
            block = place // BLOCK
            bits = np.unpackbits(np.frombuffer(self.read(bits_at + block * BLOCK // 8, BLOCK // 8), np.uint8), bitorder="little")
            if bits[place % BLOCK]:
                slot = struct.unpack("<Q", self.read(ranks_at + 8 * block, 8))[0] + int(bits[: place % BLOCK].sum())
                e = np.frombuffer(self.read(self.entries + slot * ENTRY.itemsize, ENTRY.itemsize), ENTRY)[0]
                return (int(e["seq"]), int(e["offset"]), int(e["size"])) if e["print"] == _print(k)[0] else None
        return None

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many keys at once (the whole index is read, once): found, and their entries."""
        if self.whole is None:
            self.whole, before = [], 0
            for m, bits_at, _ in self.levels:
                bits = np.unpackbits(np.frombuffer(self.read(bits_at, m // 8), np.uint8), bitorder="little").astype(bool)
                self.whole.append((bits, (np.cumsum(bits) - bits + before).astype(np.int32)))
                before += int(bits.sum())
            self.all_entries = np.frombuffer(self.read(self.entries, self.n * ENTRY.itemsize), ENTRY)
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.whole):
            at = (_level_hash(keys[left], level) % _U(len(bits))).astype(np.int64)
            hit = bits[at]
            slot[left[hit]] = rank[at[hit]]
            left = left[~hit]
        entries = self.all_entries
        found = slot >= 0
        got = entries[np.where(found, slot, 0)] if self.n else np.zeros(len(keys), ENTRY)
        return found & (got["print"] == _print(keys)), got


class Folder:
    """Raw files of an output folder, on any store that Arrow reaches by its URI."""

    def __init__(self, path: str):
        local = path[5:] if path.startswith("file:") else path
        self.fs, self.base = pafs.FileSystem.from_uri(path) if "://" in local else (pafs.LocalFileSystem(), "/" + local.lstrip("/"))

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(self.base, recursive=True)
        own, final = f"{self.base}/_{name}.{uuid.uuid4().hex}", f"{self.base}/{name}"
        with self.fs.open_output_stream(own) as f:
            f.write(data)
        try:
            self.fs.move(own, final)
        except OSError:  # stores whose rename doesn't overwrite
            self.fs.delete_file(final)
            self.fs.move(own, final)

    def read(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read()

    def reader(self, name: str) -> Callable[[int, int], bytes]:
        f = self.fs.open_input_file(f"{self.base}/{name}")
        return lambda at, n: f.read_at(n, at)


class _Part:
    """Writes the shards and the index of one part."""

    def __init__(self, out: str, part: int, shard_ids: int, width: int):
        self.folder, self.part, self.most, self.width = Folder(out), part, shard_ids, width
        self.seq = self.base = 0
        self.runs: list[list[int]] = []  # key, shard, offset, ids
        self.clear()

    def clear(self) -> None:
        self.keys: list = []
        self.sizes: list[int] = []
        self.blobs: list[bytes] = []
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.held >= self.most:
            yield self.close()
        if key is not None:
            if self.runs and self.runs[-1][0] == key:
                self.runs[-1][3] += len(ids)
            else:
                self.runs.append([key, self.seq, self.held, len(ids)])
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.blobs.append(ids.astype(f"<u{self.width}").tobytes())
        self.held += len(ids)

    def close(self) -> pa.RecordBatch:
        n_null = sum(k is None for k in self.keys)  # these come first
        real = self.keys[n_null:]
        name = f"{self.part:05d}-{self.seq:05d}"
        head = np.array([len(self.keys), n_null], "<u4").tobytes()
        self.folder.write(f"keys-{name}.bin", head + np.array([0] * n_null + real, "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes())
        self.folder.write(f"ids-{name}.bin", b"".join(self.blobs))
        row = [self.part, self.seq, self.width, self.base, self.held, len(self.keys), n_null, real[0] if real else None, real[-1] if real else None]
        self.seq, self.base = self.seq + 1, self.base + self.held
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES, strict=True)], NAMES)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield self.close()
        runs = np.array(self.runs, np.int64).reshape(-1, 4)
        self.folder.write(f"index-{self.part:05d}.mph", build_index(*(np.ascontiguousarray(runs[:, i]) for i in range(4))))


def write_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text; null text: empty) and write the files under out, in ascending doc_id order.

    Null ids come first and aren't indexed. Repeated ids keep all their records, side by side in the order of
    their texts' hashes; the index gives them as one run, which may go on in the next shards and parts, so no
    key, however frequent, makes a large shard or part. Columns besides these two aren't read. No rows give no shards.
    """
    spark = prepare(docs.sparkSession)
    path = path or tokenizer_path(TOKENIZER)
    lots = lots_of(docs)
    width = 2 if max(vocabulary_size(path) - 1, end_id) < 1 << 16 else 4

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = _Part(out, TaskContext.get().partitionId(), shard_ids, width)
        any_row = False
        for batch in batches:
            any_row |= batch.num_rows > 0
            keys = batch.column("doc_id").to_pylist()
            data, off = text_buffer(batch.column("text"))
            for lo, hi in row_blocks(off):
                ids, n = encoder(path, False).encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for key, stop, size in zip(keys[lo:hi], np.cumsum(n).tolist(), n.tolist(), strict=True):
                    yield from part.add(key, np.append(ids[stop - size : stop], np.uint32(end_id)))
        if any_row:
            yield from part.finish()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_n"]
    rows.repartitionByRange(lots, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(kernel, MANIFEST).write.parquet(f"{out}/manifest")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Every record in the files, keyed ones by their place in the index: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all records before it. Records that share a key are told apart by their order
    inside the key's run; those without a key are read by position.
    """
    shards = manifest(prepare(spark), out)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one number for each part
    before, so_far = {}, 0
    for part, n in totals:
        before[part] = so_far
        so_far += n
    before_parts = spark.sparkContext.broadcast(before)
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(totals))  # shards of a part follow each other in one task

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(out)
        held: dict[int, Index] = {}
        for b in batches:
            for row in b.to_pylist():
                part, name = row["part"], f"{row['part']:05d}-{row['seq']:05d}"
                if part not in held:
                    held.clear()
                    held[part] = Index(folder.reader(f"index-{part:05d}.mph"))
                raw = folder.read(f"keys-{name}.bin")
                n, n_null = np.frombuffer(raw, "<u4", 2).tolist()
                keys, size = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n).astype(np.int64)
                real, own = keys[n_null:], np.cumsum(size) - size
                found, entry = held[part].lookup(real)
                alone = (np.append(True, real[1:] != real[:-1]) & np.append(real[1:] != real[:-1], True))[: len(real)]
                alone &= entry["size"].astype(np.int64) == size[n_null:]
                # a key with one record is read where the index says; of a run, the records follow its begin
                at = own.copy()
                at[n_null:][alone] = entry["offset"][alone].astype(np.int64)
                if not found.all() or (entry["seq"][alone] != row["seq"]).any() or (at != own).any():
                    raise ValueError(f"the index of part {part} doesn't give what shard {name} holds")
                ids = np.frombuffer(folder.read(f"ids-{name}.bin"), f"<u{row['width']}").astype("<u4")
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
                base = row["base"] + before_parts.value[part]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64), mask=np.arange(n) < n_null), pa.array(at + base), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(lots, "part").sortWithinPartitions("part", "seq").mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Store:
    """Keyed reads of single documents from the files. Holds the first and last key of each part and opened indexes."""

    def __init__(self, spark: SparkSession, out: str):
        keyed = manifest(spark, out).groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"), F.max("width").alias("width")).where("lo is not null")
        rows = sorted((r["part"], r["lo"], r["hi"], r["width"]) for r in keyed.collect())  # one row for each part
        self.width = rows[0][3] if rows else 4
        self.parts, self.lo, self.hi = ([r[i] for r in rows] for i in range(3))
        self.folder = Folder(out)
        self.indexes: dict[int, Index] = {}
        self.ids_read = 0

    def _ids(self, part: int, seq: int, offset: int, size: int) -> np.ndarray:
        """size ids from a place of a shard; a run goes on at the begin of the next."""
        out = []
        while size > 0:
            got = self.folder.reader(f"ids-{part:05d}-{seq:05d}.bin")(self.width * offset, self.width * size)
            out.append(np.frombuffer(got, f"<u{self.width}").astype("<u4"))
            size, seq, offset = size - len(out[-1]), seq + 1, 0
        self.ids_read += sum(map(len, out))
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def fetch(self, key: int) -> list[int] | None:
        """Ids of all records of one key, one after another; None where there is none."""
        found = []
        for i in range(bisect_left(self.hi, key), bisect_right(self.lo, key)):
            part = self.parts[i]
            if part not in self.indexes:
                self.indexes[part] = Index(self.folder.reader(f"index-{part:05d}.mph"))
            place = self.indexes[part].find(key)
            if place:
                found.append(self._ids(part, *place))
        return np.concatenate(found).tolist() if found else None


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs' ids to files of a workspace and read every document back from them: see write_ids() and read_documents()."""
    with Workspace(docs.sparkSession, "ids") as work:
        write_ids(docs, f"{work.path}/ids", path)
        return keep(read_documents(docs.sparkSession, f"{work.path}/ids"), "ids-read")
