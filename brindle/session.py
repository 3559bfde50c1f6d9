"""Session helpers: sessions for local runs, table access, lineage cuts and scan spreading."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "brindle", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, where they would not find it by themselves.

    Workers find it if its folder is in PYTHONPATH, or is the working directory of a local session, or if it is installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    found = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in root or (sc.master.startswith("local") and os.getcwd() == root)
    if found or getattr(sc, "_brindle_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "brindle.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "brindle")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)  # Spark serves it to the executors
    sc._brindle_shipped = True


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; fall back to a private folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "brindle-checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application that all executors share: the one in which lineage is cut."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The files are written once, by one job; a lost executor costs nothing that was written.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def one_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct, by a scalar subquery; null where it has none."""
    return df.select(F.struct("*")).scalar()


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core.

    Only inputs with fewer splits than the cluster has cores (a handful of row groups) are moved; a large
    table has more splits than cores and is returned as it is, without a shuffle. So is anything that is not a plain scan: its
    partitions are adaptive execution's business, and are not known before it runs.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < plan.execute().getNumPartitions() < cores else df
