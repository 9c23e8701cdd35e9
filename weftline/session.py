"""Sessions, and the shared folder in which long plans are cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What every session of this package expects; cluster settings come from the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def get_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's settings; dots in names of extra settings are written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Levels of zstd for tables, by name, that hold texts a second time; 3 is Spark's own.
LEVELS = {"stored": 9}


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on no Arrow batch of the session holds much more than `most` bytes: executors hold several of each task, inside and outside Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = int(spark.conf.get(key).rstrip("bB"))
    if not 0 < kept <= most:
        spark.conf.set(key, str(most))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: the lineage ends here, and lost executors lose nothing.

    Results may read these tables until they are consumed, so the application's folder is deleted by whoever runs it.
    """
    path = f"{shared_dir(df.sparkSession)}/weftline-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(LEVELS.get(name, 3))).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of a table made from `source`, written in the shared folder when an application first asks for it."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _written:
        path = f"{shared_dir(spark)}/weftline-{key[0]}/{name}-{uuid.uuid4().hex}"
        write(path)
        _written[key] = path
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files, dealt over all cores for work that is dear by row: a file of one row group is one task however many
    splits it has. Tables of many files, as all large ones are, are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df
