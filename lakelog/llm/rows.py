"""Reading the given tables and mapping their rows in bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Characters of text and rows that are worked on together inside a task; a longer text is a slice of its own.
SLICE_CHARS = 1 << 20
SLICE_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def empty_like(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def slices(
    batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS, rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose texts together stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = size = 0
    for i, length in enumerate(lengths):
        if i > start and (size + length > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices. ``make`` runs once per task and returns the function of a slice.

    That function returns one list or array per column of ``schema``; all are equally long.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, text):
                columns = function(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def texts_of(part: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a slice; null is empty."""
    return [t or "" for t in part.column(name).to_pylist()]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and Catalyst knows their size."""
    from lakelog.sinks.storage import fresh_path

    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
