"""Reading tables, sizing shuffles and cutting lineage for the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes (as Spark's statistics give them) that one bucket of a blob exchange is to hold.
BUCKET_BYTES = 12 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: Stands for a null id inside the exchanges; a null id sorts first and comes back as null.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches are kept small, for texts are long and executors' Python workers share one limit."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size; file sizes for a Parquet scan. No job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, per: int = BUCKET_BYTES) -> int:
    """Number of hash buckets, in proportion to the input, so that one bucket's size stays constant."""
    return max(8, min(1 << 20, math.ceil(input_bytes(df) / per)))


#: Folders made where the setting is missing, by application.
_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it names none: a temporary folder if all runs in one process (tests), else a folder in the warehouse, which executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        app = context.applicationId
        if app not in _OWN:
            alone = context.master == "local" or context.master.startswith("local[")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="llm-checkpoint-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint-{app}"
        root = _OWN[app]
    return root.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(schema).parquet(path)


#: Rows of a few numbers each up to which a side of a join is broadcast (some 10 MB).
SMALL_ROWS = 1 << 18


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written frame, to be broadcast if it is counted to have at most `most` rows; else the planner joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= most else df


#: Folders that cut() has written in this process.
_WRITTEN: list[str] = []


def note(path: str) -> None:
    """A folder that was written otherwise is to be removed with those of cut()."""
    _WRITTEN.append(path)


def written() -> int:
    """A mark for forget(): how many folders cut() has written and nobody has removed."""
    return len(_WRITTEN)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession, since: int = 0) -> int:
    """Remove the intermediate folders that cut() wrote after a mark, once the results made of them are written; their number."""
    gone = _WRITTEN[since:]
    del _WRITTEN[since:]
    for path in gone:
        remove(spark, path)
    return len(gone)
