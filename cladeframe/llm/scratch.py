"""Tables written to the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="cladeframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """Bound Arrow batches by rows and bytes while a table is written; the caller's settings come back after it."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {}
    for k, most in keys.items():
        now = spark.conf.get(k, None)
        before[k] = now
        if now is None or not str(now).lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, now in before.items():
            spark.conf.unset(k) if now is None else spark.conf.set(k, now)


class Scratch:
    """Parquet tables of one operator call under the shared folder.

    An operator drops the tables that its result does not read before it returns; what is left goes when the
    Python process ends, or with ``remove`` when the caller needs the result no more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.made = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again, with the schema known, so that no job infers it."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        if self.made == 1:
            atexit.register(self.remove)
        if self.made % 4 == 0:  # else shuffle files of tables that are done stay until the driver happens to collect its garbage
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if t._scratch_path in self.paths:
                self.paths.remove(t._scratch_path)
                self._delete(t._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {t._scratch_path for t in tables}
        for path in [p for p in self.paths if p not in kept]:
            self.paths.remove(path)
            self._delete(path)

    def remove(self) -> None:
        """Delete what is left, if the session still runs."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
