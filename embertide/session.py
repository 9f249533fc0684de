"""Session and table helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANED: set[str] = set()


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the queries are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("embertide")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df written as Parquet into the folder that spark.checkpoint.dir names and read back, so that plans built on it start there; it goes when the
    application ends.

    Where that is unset, a folder of this session's own if everything runs on this machine, else an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="embertide-"))
    app = spark.sparkContext.applicationId
    folder = f"{root.rstrip('/')}/embertide-cut/{app}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if app not in _CLEANED:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        _CLEANED.add(app)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be a file, a folder or any Hadoop URL."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
