"""What the operators share: tables, the shared folder, staging and labels."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python task at once, whatever the number of rows.
ARROW_BYTES = 8 << 20
#: Rows of a few numbers that a task writes into one file, and files that a table of them has at most if it has fewer rows.
FILE_ROWS, FILES = 50_000, 12
ROOT = Path(__file__).resolve().parents[2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; also makes the package importable on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors unless PYTHONPATH already has it for them; keeps Arrow batches of texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_matrixlake", False):
        return
    d = tempfile.mkdtemp()  # only the driver's archive of the code; executors fetch it whenever they start
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "matrixlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "matrixlake").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)
    sc._matrixlake = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="matrixlake-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


class scratch:  # noqa: N801
    """with scratch() as s: what is staged within goes at its end, but for what s.keep() names, which is the outer one's then."""

    open: list[scratch] = []

    def __enter__(self) -> scratch:
        self.paths: dict[str, SparkSession] = {}
        scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        scratch.open.remove(self)
        for path, spark in self.paths.items():
            _delete(spark, path)

    @classmethod
    def note(cls, spark: SparkSession, path: str) -> None:
        """A path goes with the innermost scratch, if there is one."""
        if cls.open:
            cls.open[-1].paths[path] = spark

    def keep(self, df: DataFrame) -> DataFrame:
        spark = self.paths.pop(df._staged)
        outer = scratch.open[: scratch.open.index(self)]
        if outer:
            outer[-1].paths[df._staged] = spark
        return df


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: what follows starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    scratch.note(spark, path)
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, about so many rows of a few numbers, in no more partitions than they need, whatever the number of shuffle partitions.

    For each folder and file that a task writes to a local disk, an executor without Hadoop's native library starts a process
    (chmod), and until that process has a memory of its own, the executor's counts twice for whoever adds up the two.
    """
    return df.coalesce(max(FILES, -(-rows // FILE_ROWS)))


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: only what came of them, staged itself, is used from here on."""
    for df in tables:
        for s in scratch.open:
            s.paths.pop(df._staged, None)
        _delete(df.sparkSession, df._staged)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
