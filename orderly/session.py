"""Session set-up and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "orderly", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for (UTC, AQE with skew handling, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder takes its place in
    local mode only: on a cluster, executors would write to different disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orderly-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# Arrow batches in Python functions over texts: so many rows and bytes at most.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers are handed small, so that their memory doesn't grow with long texts. Smaller
    settings of the session stay as they are."""
    for key, most in BATCH.items():
        value = spark.conf.get(key, None)
        if value is None or not value.isdigit() or not 0 < int(value) <= most:
            spark.conf.set(key, str(most))


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and a lost
    executor costs a read instead of the whole computation before it. The shuffle files behind it are of no more use
    and are removed when the write ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orderly-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that was derived from them has been written."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("orderly-"):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
