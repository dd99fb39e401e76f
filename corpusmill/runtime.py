"""Session helpers shared by every module: tables, shared scratch space, lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corpusmill", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once per application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset.

    The fallback is a machine-local folder and so only for local masters (tests); others raise.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for a written table. It is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def _sweep() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            if spark.sparkContext._jsc is not None:
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session is gone: the folder's owner cleans up
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a compact, columnar lineage cut for larger tables."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df_columns: list[str], base: str) -> str:
    """A column name that no column of the input has (case-insensitively)."""
    taken = {c.lower() for c in df_columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


class SharedFiles:
    """Small files in the shared folder through Hadoop's file system API (any scheme the cluster has)."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.jvm, self.root = jvm, jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.root))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Written aside, then renamed: readers see all of it or nothing."""
        if not self.fs.rename(self._aside(name, text), self.path(name)):
            raise OSError(f"{name} is there already: another run has published it")

    def replace(self, name: str, text: str) -> None:
        """Written aside, then renamed over the old file in one step."""
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.root.toUri(), self.fs.getConf())
        overwrite = self.gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context.rename(self._aside(name, text), self.path(name), overwrite)

    def _aside(self, name: str, text: str):
        aside = self.path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return aside
