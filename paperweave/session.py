"""Session helpers: the shared folder, cutting lineage, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paperweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; an existing session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors: sent to them once per application, as a zip of its sources."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(here)
        out = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, files in os.walk(here):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, here)))
        spark.sparkContext.addPyFile(out)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and everything runs on this machine (tests, a laptop) a temporary folder is made and set as
    checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return os.path.dirname(held.get().rstrip("/"))
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="paperweave-")
    sc.setCheckpointDir(own)
    return own


_OURS: dict[str, str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new, unused path below the shared folder; deleted when the session's process ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _OURS:
        base = _OURS[sc.applicationId] = f"{shared_dir(spark).rstrip('/')}/paperweave/{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        p = sc._jvm.org.apache.hadoop.fs.Path(base)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{_OURS[sc.applicationId]}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Survives the loss of executors, what reads the result twice doesn't compute it twice (nor does the writing, as an
    eager checkpoint would), and its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system; a missing path is fine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
