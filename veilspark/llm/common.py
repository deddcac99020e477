"""Shared plumbing: scratch tables on the shared folder, package shipping, packed exchanges."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import math
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()
ARROW_BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``.

    Where it is unset (tests, a laptop) and Spark runs in one process, a private folder is
    made, set as checkpoint folder and removed at exit.  On a cluster an unset folder is an
    error, since a machine-local one would not be seen by other executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
        path = "file://" + path
    return path.rstrip("/") if "://" in path else "file://" + path.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors, once for each Spark application.

    Also bounds the bytes of an Arrow batch where the session has no bound: the usual bound on rows
    lets a batch of long texts grow without limit.
    """
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match("[0-9]+", spark.conf.get(key, "1"))[0]) in (1, 2**31 - 1):  # unset, or without a bound
        spark.conf.set(key, str(ARROW_BATCH))
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    folder = tempfile.mkdtemp(prefix="veilspark-zip-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, "veilspark_package.zip")
    with open(name, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def fresh_worker(keep: str = "") -> None:
    """At the start of a task: give back what other operators have cached in this Python worker."""
    bpe = sys.modules.get("veilspark.llm.bpe")
    if bpe is not None and keep != "bpe":
        bpe.forget()
    trim()


def trim() -> None:
    """Return free memory of this Python worker to the system; workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Tables of one run, written under the shared folder so that they outlive executors.

    They stay until ``clear``, since an operator's result may read them; ``made`` lists those of
    this process, for callers that know when a result has been written.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        Scratch.made.append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: lineage ends here, and nothing is computed twice."""
        schema = df.schema
        self.names.append(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``table``, hashed into buckets by ``key``: later joins on it move only the other side."""
        full = f"{name}_{uuid.uuid4().hex[:12]}"
        df.write.bucketBy(buckets, key).option("path", self.path(name)).format("parquet").saveAsTable(full)
        out = self.spark.table(full)
        self.spark.sql(f"DROP TABLE `{full}`")  # an external table: plans that know it go on reading its files
        return out

    def clear(self) -> None:
        """Delete everything."""
        self.drop("")
        if self in Scratch.made:
            Scratch.made.remove(self)

    def free_shuffles(self) -> None:
        """Have the driver notice unused shuffles now, so that executors delete their files."""
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables whose rows have all been used."""
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n) if n else self.root)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input; where it has none, rows times the width measured on them.

    Decides on partition counts only.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    width = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    n, *got = df.agg(F.count("*"), *width).first()
    return 8 * n * len(df.columns) + sum(got)


def parts_for(size: int, each: int, least: int, most: int) -> int:
    return max(least, min(most, math.ceil(size / each)))
