"""Sessions and the shared scratch folder in which lineage is cut.

Intermediate tables are written as Parquet to the folder named by ``spark.checkpoint.dir``, which every
executor shares: they survive the loss of an executor, keep columnar statistics for later joins and can be read
by several branches of a plan. Only where that setting is absent, and only on a plain ``local[...]`` master, is
a temporary folder of this machine used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "siltstone", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings this library assumes: UTC, AQE with skew joins, no UI."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return f"file://{_own[sc.applicationId]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear_quietly)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage and fixes non-deterministic parts."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows at ``row_bytes`` each stay below ``limit`` bytes.

    Beyond that it is left to the engine's own choice, which then is a shuffled join. Counting reads footers only.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def clear_scratch() -> None:
    """Delete every intermediate table this process has written; frames built on them become unreadable."""
    while _written:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear_quietly() -> None:
    try:
        clear_scratch()
    except Exception:  # the session may be gone already
        pass
