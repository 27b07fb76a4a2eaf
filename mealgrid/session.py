"""Session for local runs, and the staging of intermediate tables."""

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession



def local_session(cores="8", app="mealgrid", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Session settings that matter for wide projections of text expressions.

    The JVM does not compile methods above 8000 bytes. With this limit a stage
    that would need one is run as separate, compiled projections instead of
    one interpreted method.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="mealgrid-")


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return _local_root()


_scopes: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scopes", default=None)


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside the block when it ends.

    For work that is done batch by batch: write the batch's result inside the
    block, since staged tables are gone after it.
    """
    paths: list[str] = []
    token = _scopes.set(paths)
    try:
        yield
    finally:
        _scopes.reset(token)
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over as many tasks as a shuffle has.

    For short rows that much work is done on: a table in one small file is one
    task otherwise. The number is given, so that small tasks are not joined again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def stage(df: DataFrame, name: str = "stage", partition: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, with a folder for each value of ``partition``.

    Cuts the lineage on storage that outlives executors, and gives the planner
    the true size of the table, so that a broadcast is chosen only when the
    written files are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{staging_root(spark)}/mealgrid/{app}/{name}-{uuid.uuid4().hex}"
    paths = _scopes.get()
    if paths is not None:
        paths.append(path)
    if partition:
        df.hint("rebalance", partition).write.partitionBy(partition).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

