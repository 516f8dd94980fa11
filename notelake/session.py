"""Session building and table access shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables a data folder may hold, one Parquet dataset each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "notelake", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the data folder's tables; Parquet, so filters and column choices reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt out by ``key`` over three tasks a core. A well compressed table lies in few row groups, each read by one task; where much is made of each row, that task would be the whole job."""
    return df.repartition(3 * max(1, df.sparkSession.sparkContext.defaultParallelism), key)


_own_base: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset, a session of one machine gets a temporary folder; any other would split its data over local disks, so it raises."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_base.get(context.applicationId) or _own_base.setdefault(context.applicationId, tempfile.mkdtemp(prefix="notelake-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_cuts: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the folder all executors share and returns it read again, so that what makes its rows is done once however often they are read. Removed when the driver ends with its session still up."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if not _cuts:
        atexit.register(_sweep)
    _cuts.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _cuts:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
