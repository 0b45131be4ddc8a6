"""Reading tables, cutting lineage in the shared folder, hot keys, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.session import ship_code

#: Letters that lower-casing touches in every contract of this subpackage.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch. Texts are long, so the default of 10,000 would fill a worker.
BATCH_ROWS = 500
#: Bytes of text that a numpy kernel takes at once (a longer text goes alone).
CHUNK_BYTES = 1 << 20
#: Rows of one key that a join leaves in one task, and most keys that are split (the most frequent ones).
KEY_ROWS, HOT_KEYS = 20_000, 100_000

_own_dir: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on workers and keep Arrow batches small."""
    ship_code(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master
    gets a temporary folder, a cluster the user's folder of its default file system if that is no local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if fs.getUri().getScheme() != "file":
            return f"{fs.getHomeDirectory()}/.strandline/{spark.sparkContext.applicationId}"
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="strandline-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


class Workspace:
    """A folder of one run's intermediate tables, deleted when the run ends, be it by an error.

    Nothing that leaves the `with` block may still read from it: results go to keep().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = prepare(spark), shared_path(spark, name)
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.n = 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.paths.clear()
        delete(self.spark, self.path)

    def store(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """Write df and read it again: later steps survive lost executors without recomputing it.

        parts: most files, for tables that are small beside the corpus.
        """
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        out = _stored(df, path, parts)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables early, once all that is made of them is stored itself."""
        for t in tables:
            found = self.paths.pop(id(t), None)
            if found:
                delete(self.spark, found[1])


def _stored(df: DataFrame, path: str, parts: int | None) -> DataFrame:
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Store a result that outlives its run; its folder goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    out = _stored(df, path, parts)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return out


def lots_of(df: DataFrame) -> int:
    """Parts for what is made of df row by row: they follow its size, as its scan's do, and are at least those of a shuffle."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def packed(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """docs as the named columns and one struct `_rest` of all others, so that no name of theirs can clash;
    and the columns that unpack it, in the order of docs."""
    rest = [c for c in docs.columns if c not in names]
    inner = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(None).cast("int")

    def unpack(df: DataFrame) -> list[Column]:
        at = {c: i for i, c in enumerate(rest)}
        return [df["_rest"][f"c{at[c]}"].alias(c) if c in at else df[c] for c in docs.columns]

    return docs.select(*[docs[f"`{c}`"] for c in names], inner.alias("_rest")), unpack


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of df and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def salted_join(work: Workspace, left: DataFrame, right: DataFrame, key: list[str], spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right (each key once), where a key with many rows in left is split over several tasks.

    Rows of keys with over KEY_ROWS are dealt by `spread` and the right row is repeated, once for each
    KEY_ROWS. At most HOT_KEYS keys are split and broadcast: any other has under 1 / HOT_KEYS of the rows.
    counts: rows of each key (_n), where they are known.
    """
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > KEY_ROWS).orderBy(F.desc("_n"), *key).limit(HOT_KEYS)
    hot = work.store(hot.select(*key, F.ceil(F.col("_n") / KEY_ROWS).cast("int").alias("_lots")), "hot", 1)
    if hot.isEmpty():
        work.drop(hot)
        return left.join(right, key, how)
    lots = F.coalesce("_lots", F.lit(1))
    one = left.join(F.broadcast(hot), key, "left").withColumn("_lot", F.pmod(F.xxhash64(spread), lots).cast("int")).drop("_lots")
    many = right.join(F.broadcast(hot), key, "left").withColumn("_lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("_lots")
    return one.join(many, [*key, "_lot"], how).drop("_lot")


def placed(work: Workspace, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df stored in sorted runs, with `run` and `place`, its place in the whole order from 0."""
    sorted_runs = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = work.store(sorted_runs, name)
    at, run = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)
    stored = stored.withColumn("run", run)
    # One row for each task that sorted: their counts are summed up in one window, and broadcast.
    sizes = stored.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("run", (F.sum("_n").over(Window.orderBy("run")) - F.col("_n")).alias("_before"))
    return stored.join(F.broadcast(before), "run").withColumn("place", at + F.col("_before")).drop("_at", "_before")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (rows + 1, from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def row_blocks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes; a longer row goes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
