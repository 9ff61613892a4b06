"""Session settings and the shared checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Call sites of column expressions cost a round trip to the JVM each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(app_name: str = "cohort_gaps", **extra: str) -> SparkSession:
    """A session with the settings the jobs expect; the master comes from the environment."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="cohort-gaps-checkpoint-")
    context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it from there.

    Later plans start from the files: nothing upstream runs again when they use the table several times or lose an
    executor, and unlike an RDD checkpoint the table keeps column pruning, filters and its size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    for open_ in _scratches:
        open_.written.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut_lineage`` that nothing reads any more, so that long jobs hold one round of them only."""
    for table in tables:
        context = table.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            continue
        own = context.getCheckpointDir().rstrip("/").rsplit("/", 1)[1]
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            # Nothing but what ``cut_lineage`` wrote is ever removed.
            if path.rsplit("/", 2)[1] == own and path.endswith(".parquet"):
                _remove(table.sparkSession, path)
                for open_ in _scratches:
                    open_.written = {p for p in open_.written if p.rsplit("/", 1)[1] != path.rsplit("/", 1)[1]}


class Scratch:
    """Tables that ``cut_lineage`` wrote while this was open."""

    def __init__(self, spark: SparkSession):
        self.spark, self.written = spark, set()

    def keep_all_of(self, results: Iterable[DataFrame]) -> None:
        """Leave the tables that these plans read."""
        for df in results:
            self.written -= {p for p in self.written if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles())}

    def remove(self) -> None:
        for path in self.written:
            _remove(self.spark, path)


_scratches: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Remove what ``cut_lineage`` writes inside the block when it ends, but for what ``keep_all_of`` names."""
    own = Scratch(spark)
    _scratches.append(own)
    try:
        yield own
    finally:
        _scratches.remove(own)
        own.remove()
