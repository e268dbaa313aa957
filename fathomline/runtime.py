"""Session helpers shared by every operator: settings, table access, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "fathomline", **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The files outlive any executor, so a later stage that is retried rereads them instead of
    recomputing the plan above; columns are compressed, unlike a checkpoint's rows. Tables lie in
    a folder of their application, which ``clear`` deletes; ``discard`` deletes one. Planning and compiling
    such a plan leaves the driver with freed memory outside its heap, which goes back to the system here.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("error").option("compression", compression).parquet(path)
    give_back(spark)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def give_back(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed outside its heap to the system.

    The C library keeps it, by thread, so it adds up over many plans compiled. A JVM without the command
    (below 17.0.9, or not on Linux) keeps it still.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        invoke = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"][0]
        given = new(jvm.java.lang.Object, 4)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``clear``."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store Spark reaches."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in store.listStatus(there)] if store.exists(there) else []


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` made, once nothing that is still to run reads them."""
    for df in tables:
        delete(df.sparkSession, df._written_to)


def clear(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` made in this application, when their results are stored elsewhere."""
    delete(spark, _own_folder(spark))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str) -> int:
    """Total UTF-8 length of a column (one narrow aggregate)."""
    row = df.agg(F.sum(F.octet_length(F.col(column)).cast("bigint")).alias("n")).first()
    return int(row["n"] or 0)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so Arrow functions import it there.

    Where the session keeps Spark's default of 10,000 rows to an Arrow batch, it becomes 2,000: rows
    here are texts, and both sides of the pipe hold whole batches beside the heap.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "2000")
    if _SHIPPED.get(sc.applicationId):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="fathomline-ship-"), "fathomline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("fathomline", os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED[sc.applicationId] = True
