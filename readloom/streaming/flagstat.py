"""Running flag statistics over a stream of alignment files.

The counters are additive, so the batch aggregate serves as it is; state is one
row of counters however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import flagstat

FIELDS = "flag int, ref_id int, next_ref_id int, mapq smallint"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of alignments as they arrive; only the counters' columns are read."""
    return spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running(alignments: DataFrame) -> DataFrame:
    """One row of totals so far (complete mode)."""
    return flagstat.wide(alignments)


def start(alignments: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Totals in the in-memory table ``name``."""
    return running(alignments).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
