"""Session helpers: building a session for tests/bench, checkpoint folder,
table access by scale-factor folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, app_name: str = "tessera",
                shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Session for local runs. On a cluster, ``getOrCreate`` returns the
    session the launcher made and only the SQL confs below are applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    defaults.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    That setting names a folder all executors share (a ``file:`` path is then
    a shared mount). Only when it is absent *and* Spark runs in local mode
    (tests, bench) do we make our own scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive
    executor loss.
    """
    try:
        sc = spark.sparkContext
    except Exception:   # Connect session: only the configured folder can be used
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
    folder = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_RUN = f"tessera-run-{uuid.uuid4().hex}"
_run_folders: set[str] = set()


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _delete_run_folder(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            delete_path(spark, path)
    except Exception:   # the session is gone; the folder is left to the cluster's own clearing
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place for a written intermediate table in this run's folder under the
    checkpoint dir. Results read these tables lazily, so the folder stays while
    the driver lives and is deleted when it ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{_RUN}"
    if folder not in _run_folders:
        _run_folders.add(folder)
        atexit.register(_delete_run_folder, spark, folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` once as Parquet under the checkpoint
    folder and reading it back (one computation, unlike an eager reliable
    checkpoint, which computes the plan a second time to write it)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (Parquet) of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
