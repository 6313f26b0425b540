"""Session helpers that every part of the engine shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[int, str] = {}
_LOCAL: dict[str, str] = {}
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20)  # setting, Spark's own value, this package's
PACKED = ("spark.sql.sources.fileCompressionFactor", "1.0", "60.0")  # bytes of rows in memory for a byte of a file: written keys and numbers in order take little room


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark application (``--py-files`` in code)."""
    sc = spark.sparkContext
    app = sc.applicationId
    name, plain, own = BATCH
    if spark.conf.get(name).rstrip("b") == str(plain):  # smaller batches to Python workers bound their memory when rows are long
        spark.conf.set(name, own)
    if _SHIPPED.get(id(sc)) == app:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "factloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(target)
    _SHIPPED[id(sc)] = app


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in a session without one (tests), a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="factloom-shared-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


class Scratch:
    """Written tables in the shared folder that cut lineage and survive lost executors.

    ``keep`` writes a DataFrame and returns the reread table; ``drop`` removes tables that
    no later plan reads. What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.at: dict[int, tuple[DataFrame, str]] = {}
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)
        self.fs.deleteOnExit(self.path)
        name, plain, own = PACKED
        if spark.conf.get(name) == plain:  # or joins take a table for small that a few compressed bytes stand for, and broadcast it through the driver
            spark.conf.set(name, own)

    def keep(self, df: DataFrame, *by: str, compression: str = "zstd", tasks: int | None = None, options: dict | None = None) -> DataFrame:
        """Write and reread. ``tasks``: at most so many, for a result that is known to be small beside the shuffle before it. ``options`` of the writer."""
        df = df.coalesce(tasks) if tasks else df
        self.n += 1
        path = f"{self.base}/{self.n}"
        out = df.write.options(**(options or {})).option("compression", compression).mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            held = self.at.pop(id(t), None) if t is not None else None
            if held:
                self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held[1]), True)

    def only(self, *tables: DataFrame) -> None:
        """Remove all tables but these."""
        self.drop(*(t for t, _ in list(self.at.values()) if not any(t is x for x in tables)))
