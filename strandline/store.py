"""Tables that an operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Store:
    """Tables under one folder, which goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        fs, p = self._at("")
        fs.deleteOnExit(p)

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Written and read again, so that what follows does not depend on how it was made."""
        self.n += 1
        path = f"{self.path}/{name}-{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str, *by: str) -> None:
        """More rows of a table that lies in folders by the columns `by`."""
        df.write.mode("append").partitionBy(*by).parquet(f"{self.path}/{name}")

    def part(self, name: str, schema: str, **of: int) -> DataFrame:
        """The rows of one folder of such a table; none if it isn't there."""
        at = "/".join(f"{k}={v}" for k, v in of.items())
        fs, p = self._at(f"{name}/{at}")
        found = fs.globStatus(p)
        return self.spark.read.schema(schema).parquet(*[str(f.getPath()) for f in found]) if found else self.spark.createDataFrame([], schema)

    def drop(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)
