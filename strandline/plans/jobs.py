"""Long computations in the background, under a Spark tag by which they can be stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from strandline.errors import CancelledError

_pool = ThreadPoolExecutor(4, thread_name_prefix="strandline")


class Job:
    def __init__(self, spark: SparkSession, work: Callable[[], Any], label: str = "job"):
        self.spark, self.label, self.tag, self._stopped = spark, label, f"strandline-{uuid.uuid4().hex}", False

        def run() -> Any:
            spark.addTag(self.tag)
            try:
                return work()
            except Exception as e:
                if self._stopped:
                    raise CancelledError(label) from e
                raise
            finally:
                spark.removeTag(self.tag)

        self._future: Future = _pool.submit(inheritable_thread_target(spark)(run))

    def poll(self) -> bool:
        return self._future.done()

    def result(self, timeout: float | None = None) -> Any:
        return self._future.result(timeout)

    def cancel(self) -> None:
        self._stopped = True
        self.spark.interruptTag(self.tag)
