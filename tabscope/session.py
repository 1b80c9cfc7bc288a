"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library depends on. ANSI stays on (Spark's default); the
# operators guard their own divisions instead of turning it off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are deleted by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "tabscope",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults applied."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


# Bytes of an Arrow batch sent to Python at once (unless the session names its own): rows of long texts would make
# batches of ten thousand rows too large for small executors.
ARROW_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session ready for the library: checkpoint folder, Arrow batch size, package on the executors."""
    ensure_checkpoint_dir(spark)
    for key, value in ARROW_BATCH.items():
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python path once per application.

    Arrow UDFs and grouped maps reference helpers of this package; on a
    cluster the executors import it from the zip distributed by Spark.
    """
    import shutil

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="tabscope-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "tabscope"), "zip",
                                  root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(archive)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring the cluster's setting.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it a cluster is refused, as its machines would not see
    each other's files. Local runs and tests get a private folder under the
    system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {sc.master} share")
        configured = tempfile.mkdtemp(prefix="tabscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint so later passes see one result.

    Used where two passes over a frame must agree row for row (for example a
    range partitioning whose partition ids are read twice).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the checkpoint folder and read it back: cuts lineage, later scans read only their columns."""
    if len({c.lower() for c in df.columns}) < len(df.columns) or any(t == "void" for _, t in df.dtypes):
        return stable(df)  # Parquet holds no such columns
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
