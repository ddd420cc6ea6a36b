"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word definition: the ASCII space and U+0009 to U+000D.
WORD_SPLIT = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of rows that are sent to every task (8 bytes each); more of them meet the rows in a shuffle.
BROADCAST_KEYS = 1 << 20
#: Rows and bytes of an Arrow batch: texts are long, and a task holds several batches on either side.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: A key is hot when it holds more than one in so many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table as written, with only ``columns`` when some are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; an own temporary folder stands in for it on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="trawl-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return to the system what this Python process has freed."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches that fit long texts; the session's own limits stay where they are smaller."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))

    def released(batches):
        yield from run(batches)
        # Workers live on after a task.
        give_back()

    return df.mapInArrow(released, schema)


def local_rows(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A small table of the driver's, handed over as Arrow so that no executor starts a Python worker for it."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}))


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles and checkpoints that nothing refers to any more; the driver's freed memory goes back to the system."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """Return to the system what the driver's JVM has freed outside its heap, which its C library keeps otherwise.

    JVMs without the command (before 17.0.9) keep it.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName

    def array(kind, *items):
        out = new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    with contextlib.suppress(Py4JError):
        kinds = map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        # The server's own class is closed to reflection, its interface is not.
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none = array(jvm.java.lang.Object), array(jvm.java.lang.String)
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", *none))


def without_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``row_key`` is among ``keys`` (one column); up to ``BROADCAST_KEYS`` of them texts stay where they lie."""
    name = free_name(df, "key")
    gone = keys.toDF("_gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return df.withColumn(name, row_key(df)).join(side, F.col(name) == F.col("_gone"), "left_anti").drop(name)


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row: rows with one key are the same row (maps, which Spark can't hash, are left out)."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*cols, *(c.isNull() for c in cols))


def joined_labels(rows: DataFrame, labels: DataFrame, key: str, held: str = "held") -> DataFrame:
    """``rows`` with the columns of ``labels`` (one row a ``key``, ``held`` of the rows each; none missing), ``held`` dropped.

    Up to a thousand keys are broadcast, and of more those that hold over a
    thousandth of all rows, of which there are fewer, so that no task gets all
    rows of one; the others meet in a shuffle.
    """
    others = [c for c in labels.columns if c not in (key, held)]
    if labels.limit(HOT_SHARE + 1).count() <= HOT_SHARE:
        one = F.broadcast(labels.select(F.col(key).alias("_label_of"), *others))
        return rows.join(one, F.col(key) == F.col("_label_of")).drop("_label_of")
    total = labels.agg(F.sum(held)).first()[0] or 0
    hot = F.col(held) * HOT_SHARE > F.lit(total)
    few, many = (labels.where(c).select(F.col(key).alias("_label_of"), *others) for c in (hot, ~hot))
    at_hot = rows.join(F.broadcast(few), F.col(key) == F.col("_label_of")).drop("_label_of")
    rest = rows.join(F.broadcast(few.select("_label_of")), F.col(key) == F.col("_label_of"), "left_anti")
    return at_hot.unionByName(rest.join(many, F.col(key) == F.col("_label_of")).drop("_label_of"))


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Maximal runs of non-white-space, in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WORD_SPLIT), "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores appended until no column of ``df`` has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
