"""Session helpers of the engine's operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "trawl", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects, the package on its executors; ``conf`` (dots as __) overrides."""
    wanted = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
    }
    wanted["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    wanted |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.appName(name).config(map=wanted).getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; on a local master only, a temporary one stands in."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not wanted and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="trawl-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a batch and what is made of it.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session are no larger than these; its own limits stay where they are smaller."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that functions which name it run anywhere."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="trawl-package-"), "trawl-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "trawl")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    # Spark serves the file to every executor; none reads the driver's folder.
    sc.addPyFile(target)
