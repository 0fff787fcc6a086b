"""Session helpers shared by the library, the benchmark and the tests."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "lodestone") -> SparkSession:
    """A single-machine session with the settings the library assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Puts this package on the path of the Python workers of a single-machine session, once an application.

    On a cluster the executors have it installed, or get it by ``--py-files``.
    """
    context = spark.sparkContext
    if not context.master.startswith("local[") or _SHIPPED.get("to") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lodestone-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(at))
    _SHIPPED["to"] = context.applicationId


def input_bytes(df: DataFrame) -> int | None:
    """Size of what ``df`` reads, as its plan's statistics have it; None where they don't know. Nothing runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else None


def partitions_for(df: DataFrame, target: int = 64 << 20) -> int:
    """Shuffle partitions for data of the size of ``df``: the session's number, or more to keep them near ``target`` bytes."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-(input_bytes(df) or 0) // target))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a single machine) a local temporary folder stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL_ROOT:
        _LOCAL_ROOT["dir"] = tempfile.mkdtemp(prefix="lodestone-")
    return f"file://{_LOCAL_ROOT['dir']}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of the written table.

    This cuts the lineage: a lost executor costs a read, never a recomputation of the upstream plan.
    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone already
        pass
