"""Session settings, table access and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIP_LOCK = threading.Lock()
_SHIPPED: set[str] = set()


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("marlstone").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """df written once to the shared folder: its lineage is cut and a lost executor costs nothing that was finished."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run; once per application."""
    sc = spark.sparkContext
    with _SHIP_LOCK:
        if sc.applicationId in _SHIPPED:
            return
        here = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="marlstone-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
