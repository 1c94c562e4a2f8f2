"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under the one that ``spark.checkpoint.dir`` names.

    Where the setting is absent (tests, one machine) a temporary folder stands in and is set as the session's.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tandem-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tandem-{uuid.uuid4().hex}"

#: Seconds between two times that the driver gives memory back, and when it last did.
PAUSE = 5.0
_last = float("-inf")


def trim(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap back to the system; False where it can't.

    Plans are compiled in many threads, and the C library keeps what each has freed: hundreds of MB after some hundred jobs.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    try:
        kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the server's own class is closed to callers
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # another JVM or C library: memory goes back later
        return False
    return True


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, lost executors don't matter.

    The shuffle files of this one write go as soon as it has ended: nothing reads them again.  So does memory that the driver
    has freed, every ``PAUSE`` seconds at most.
    """
    global _last
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if time.monotonic() - _last > PAUSE:
        trim(spark)
        _last = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)
