"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def build_session(app: str = "patronage", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC as its zone.

    ``conf`` keys use ``__`` for dots. On a cluster leave ``master`` out and
    let spark-submit decide; partition counts are then left to AQE.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), str(value))
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's checkpoint folder.

    Only a local-mode session without that setting gets a folder of its own;
    anywhere else a machine-local folder would be lost with its machine.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get(CHECKPOINT_KEY, None) or _local_roots.get(app)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        root = _local_roots[app] = tempfile.mkdtemp(prefix="patronage-")
    return f"{root.rstrip('/')}/patronage/{app}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads a file instead of replaying the
    source scan), freezes values that several later passes must agree on, and
    keeps the data columnar so each pass reads only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_once(spark: SparkSession, name: str, make) -> DataFrame:
    """The frame that ``make()`` gives, written at its first use in this application and read back from then on.

    Spark's success mark tells a finished stage from one whose writer died;
    the latter is written anew.
    """
    path = f"{scratch_root(spark)}/once/{name}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder on whatever file system ``path`` names."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(jpath, True))


def copy_path(spark: SparkSession, source: str, target: str) -> None:
    """Copy a small folder, file by file, on whatever file systems the paths name."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    systems = [p.getFileSystem(conf) for p in paths]
    jvm.org.apache.hadoop.fs.FileUtil.copy(systems[0], paths[0], systems[1], paths[1], False, conf)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory())


def release_scratch(spark: SparkSession) -> None:
    """Drop every intermediate this application wrote."""
    delete_path(spark, scratch_root(spark))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes; -1 means never."""
    jconf = spark._jsparkSession.sessionState().conf()
    return int(jconf.autoBroadcastJoinThreshold())
