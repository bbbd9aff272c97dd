"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for. AQE re-plans joins at runtime (switches a
# shuffle join to broadcast once the measured side is small, splits skewed join
# partitions) and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # remove checkpoint files of DataFrames that are no longer referenced, so
    # repeated propagation runs do not fill the shared checkpoint folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "geotrail", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only when it is unset *and* the master is local (tests) is a fresh
    scratch folder created. On a cluster without the setting this raises:
    a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not re.match(r"local($|\[)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="geotrail-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stored in the shared folder and read back (see ``store``).

    One job: an eager ``checkpoint()`` would compute the rows twice, once for
    its action and once for the files."""
    return store(df, "cut")


def _delete(spark: SparkSession, path: str) -> None:
    """Best effort removal of a folder through Spark's own file system."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder is scratch space
        pass


_SCRATCH: set[str] = set()
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder.

    All folders of one application lie under one parent, which is deleted when
    the driver's Python ends while the session still runs; those of a
    ``scratch_scope`` go when it ends."""
    root = f"{ensure_checkpoint_dir(spark)}/tables"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_delete, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the tables stored inside when the block ends.

    For sessions that run many queries: build a query's DataFrame and write or collect
    its result inside one scope; DataFrames from inside cannot be read afterwards."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


STORE_LISTENERS: list = []      # called with (df, name) before a table is stored (plan reports)


def store(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a checkpoint, and the reader prunes columns and
    knows the true size of the table (so Catalyst can choose a broadcast
    from a measured size). Works for empty tables too."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for listener in STORE_LISTENERS:
        listener(df, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
