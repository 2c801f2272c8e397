"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# UTC makes second/nano columns and rendered times independent of the host.
REQUIRED_SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of making the text invalid.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Good defaults for clusters and for local runs; callers may override any.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Noting the line of every expression halves the speed at which plans are built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "siemspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **REQUIRED_SQL_CONF}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return ensure_settings(builder.getOrCreate())


def ensure_settings(spark: SparkSession) -> SparkSession:
    """Applies the settings results depend on to a session built elsewhere."""
    for key, value in REQUIRED_SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship_helpers()
    return spark


def _ship_helpers() -> None:
    """Sends the few Python helpers that run in tasks along with the job.

    Executors then need not have this package installed.
    """
    import siemspark
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(siemspark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``.  Only
    where that is unset (tests, a laptop) a local folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "siemspark-shared")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df, purpose: str = "cut"):
    """Writes ``df`` once to the shared folder and reads it back.

    Unlike a local checkpoint the copy survives the loss of an executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
