"""Session helpers: one place for the Spark settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "rewardframe") -> SparkSession:
    """Local session for tests and benches. On a cluster, use the cluster's session as is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # JSON records with a repeated key keep the last value, as Python's json.loads does
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RF_DRIVER_MEMORY", "8g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session (``spark.checkpoint.dir``). Only a
    local-mode session without one (tests, local runs) gets a scratch folder of its own."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has several machines' folders
        # a machine-local folder is not visible to other executors and is lost with them
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    local = tempfile.mkdtemp(prefix="rf-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)  # this process's own scratch folder
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given (read-only) input tables. The DataFrame is reused per session and path
    (kept on the session object, so a new session starts empty), so its file listing and
    footer schema are read once; it holds no data."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    cache = spark.__dict__.setdefault("_rf_tables", {})
    df = cache.get(path)
    if df is None:
        df = cache[path] = spark.read.parquet(path)
    return df


def ship_package(spark: SparkSession) -> None:
    """Make ``rewardframe`` importable in Python workers (Arrow UDFs, UDTFs, mapInPandas).

    The package is zipped once per driver process and added with ``addPyFile``, which
    distributes it to every executor through Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rf_shipped", False):  # flag on the context itself: a new context ships again
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="rf-pkg-"), "rewardframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._rf_shipped = True


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin spread ahead of CPU-heavy row work (regex, parsing, Arrow UDFs) when the scan
    yields fewer partitions than the session can run at once (one large row group, a few big
    files). On a large input the scan already has thousands of splits and this is a no-op, so
    the extra exchange only happens where it buys parallelism."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never ``localCheckpoint``): cuts
    the lineage, and a frame read by several branches of a plan is computed once. The application's
    own folder of checkpoints goes when its JVM ends."""
    ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    own = sc.getCheckpointDir()  # Spark makes a folder for each application below the one that it is given
    if own and getattr(sc, "_rf_checkpoints", None) != own:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc._rf_checkpoints = own
    return df.checkpoint(eager=True)
