"""Session settings, table loading and scratch tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of every executor, once per application; needed where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="skein-ship-")) / f"{home.name}.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(master)
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Table ``table`` of ``folder``; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset and all
    work is done by one machine. On a cluster without the setting: an error, for a local folder would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh name in the shared folder, deleted with the scratch tables."""
    path = f"{scratch_root(spark)}/skein/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process; call it after the results have been written."""
    n = 0
    for s, path in [x for x in _SCRATCH if x[0] is spark]:
        jvm = s.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _SCRATCH.remove((s, path))
        n += 1
    return n
