"""Session settings and the shared scratch folder that cuts lineage.

Long or iterative jobs write intermediate tables to the folder that the cluster
names in ``spark.checkpoint.dir``.  A lost executor then costs the re-run of its
tasks against files every other executor can read, never the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the package is tuned for; ``build_session`` applies them, a cluster may override any.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python, once per context; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._tidemark_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder for lineage cuts: spark.checkpoint.dir, else a temporary one in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(made)
    return made


class Scratch:
    """Named Parquet tables of one operator run under the shared folder.

    ``save`` writes and re-reads a DataFrame (a written table, so later stages
    never recompute it); ``drop`` frees a table that no returned DataFrame reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        schema = df.schema
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Kept:
    """A table that outlives a run: numbered versions in a named folder, of which the newest complete one counts.

    A version is complete once its writer has committed it, so a run that dies
    leaves the one before; a version stays readable while the next is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        folder = self._hadoop.Path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        numbers = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [n for n in numbers if self._fs.exists(self._hadoop.Path(f"{self.path}/v{n}/_SUCCESS"))]

    def load(self) -> DataFrame | None:
        """The newest version, or None."""
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else None

    def save(self, df: DataFrame) -> DataFrame:
        """Writes the next version and reads it again."""
        found = self.versions()
        to = f"{self.path}/v{found[-1] + 1 if found else 1}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
