"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, app: str = "methyloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, one-machine use) a temporary folder is set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="methyloom-"))
    return context.getCheckpointDir()


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A table of few rows that the driver holds, as the planner knows: it is broadcast while under the threshold."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept partition by partition in the shared folder."""
    _own_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in this application's part of the shared folder."""
    return os.path.join(_own_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder. It and the folder of the application's checkpoints are deleted
    when the driver ends."""
    context = spark.sparkContext
    own = getattr(context, "_methyloom_dir", None)
    if own is None:
        own = os.path.join(shared_dir(spark), f"methyloom-{context.applicationId}")
        for folder in (own, context.getCheckpointDir()):
            place = context._jvm.org.apache.hadoop.fs.Path(folder)
            system = place.getFileSystem(context._jsc.hadoopConfiguration())
            system.mkdirs(place)
            system.deleteOnExit(place)
        context._methyloom_dir = own
    return own


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per application: a zip of its sources in the shared folder,
    handed out by Spark."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_methyloom_shipped", False) or not os.path.isdir(root):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = os.path.join(new_path(spark, "sources"), "methyloom_src.zip")
    jvm = context._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(place.toString() if "://" in target or target.startswith("file:") else target)
    context._methyloom_shipped = True
