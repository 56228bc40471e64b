"""The folder of a live summary: partial summaries by span of micro-batches, folded into ever wider spans.

A micro-batch writes the partial summary of its own rows as a span of one batch. Partial summaries add up, so ``fold``
neighbouring spans become one span, ``fold`` of those a wider one, and so on: after n batches there are about
``fold * log(n)`` folders, a row of a run is rewritten ``log(n)`` times in all, and nothing is kept in the memory of the
stream. A folder counts when its writer has committed it. Readers take the widest spans; the spans that a fold has
replaced stay until the next fold, for readers that found them before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelog.operators.reports import merge_summaries, run_summary
from lakelog.schemas import RUN_SUMMARY

FOLD = 8

Span = tuple[int, int]  # first and last micro-batch


def _name(span: Span) -> str:
    return f"span={span[0]:015d}-{span[1]:015d}"


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a folder: the stores that Spark writes to, whatever they are."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def committed_spans(spark: SparkSession, path: str) -> list[Span]:
    """Spans whose writer has finished, in order."""
    root, files = _files(spark, path)
    if not files.exists(root):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in files.listStatus(root)]
    spans = [tuple(map(int, n.removeprefix("span=").split("-"))) for n in names if n.startswith("span=")]
    return sorted(s for s in spans if files.exists(child(f"{path}/{_name(s)}/_SUCCESS")))


def widest(spans: list[Span]) -> list[Span]:
    """The spans that no other one holds: together they are every batch once."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or span[0] > kept[-1][1]:
            kept.append(span)
    return kept


def _read(spark: SparkSession, path: str, spans: list[Span]) -> DataFrame:
    if not spans:
        return spark.createDataFrame([], RUN_SUMMARY)
    return spark.read.schema(RUN_SUMMARY).parquet(*[f"{path}/{_name(s)}" for s in spans])


def folds_after(batch_id: int, fold: int) -> list[Span]:
    """The spans that are complete with this batch, narrow ones first."""
    made, width = [], fold
    while (batch_id + 1) % width == 0:
        made.append((batch_id + 1 - width, batch_id))
        width *= fold
    return made


def replaced(there: list[Span], made: list[Span]) -> list[Span]:
    """Spans that lie in another one which was there before ``made``: no reader can still be on its way to them."""
    older = [s for s in there if s not in made]
    return [s for s in there if any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in older)]


def save_batch(batch: DataFrame, batch_id: int, path: str, fold: int = FOLD) -> None:
    """Write the summary of a micro-batch's rows, and fold what is complete with it.

    A batch that is replayed after a crash writes its own span anew and leaves finished folds as they are.
    """
    spark = batch.sparkSession
    run_summary(batch).write.mode("overwrite").parquet(f"{path}/{_name((batch_id, batch_id))}")
    made = folds_after(batch_id, fold)
    if not made:
        return
    there = committed_spans(spark, path)
    for span in made:
        if span not in there:
            parts = widest([s for s in there if span[0] <= s[0] and s[1] <= span[1]])
            merge_summaries(_read(spark, path, parts)).write.mode("overwrite").parquet(f"{path}/{_name(span)}")
            there = sorted([*there, span])
    _, files = _files(spark, path)
    for span in replaced(there, made):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_name(span)}"), True)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of every run over all batches so far."""
    return merge_summaries(_read(spark, path, widest(committed_spans(spark, path))))
