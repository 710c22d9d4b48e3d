"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the operators were planned against.  Everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Without it "available now" over a source in Python is one batch, and no watermark is worked off.
    "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that matter for results or plans to a running session, and ship the code."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship_code(spark)


CODEC = "spark.sql.parquet.compression.codec"


def compact_results(spark: SparkSession) -> SparkSession:
    """Have a session that names no codec write Parquet with zstd from here on.

    For results of one row per (alert, subscriber): their ids are hex digits, which zstd halves and
    Spark's default leaves as long as they are.
    """
    if spark.conf.get(CODEC, None) is None:
        spark.conf.set(CODEC, "zstd")
    return spark


def ship_code(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Workers import the operators' functions by name; without this they find them only where
    the package is installed or lies on their path.
    """
    shipped = "spark.klaxon.shipped"
    application = spark.sparkContext.applicationId
    if spark.conf.get(shipped, None) == application:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    # addPyFile copies the file to all executors; the driver's own copy may be anywhere.
    path = os.path.join(tempfile.mkdtemp(prefix="klaxon-code-"), "klaxon-code.zip")
    with open(path, "wb") as file:
        file.write(body.getvalue())
    spark.sparkContext.addPyFile(path)
    spark.conf.set(shipped, application)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("klaxon")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local master may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="klaxon-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
