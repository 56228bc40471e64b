"""JSON log lines: records to text and text to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakelog.functions.text import iso_utc
from lakelog.schemas import LOG_LINE_KEYS, LOG_RECORDS

# The keys every log line has.
ALWAYS = ("ts", "level", "logger", "msg")
CORRUPT = "corrupt_line"

_LINE_SCHEMA = ", ".join(
    f"{f.name} {'string' if f.name == 'ts' else f.dataType.simpleString()}"
    for f in LOG_RECORDS.fields
    if f.name in LOG_LINE_KEYS
)


def to_lines(records: DataFrame) -> DataFrame:
    """One JSON object per record in column ``value``: fixed key order, null keys left out, ``ts`` in UTC."""
    keys = [iso_utc(F.col("ts")).alias("ts"), *[F.col(name) for name in LOG_LINE_KEYS if name != "ts"]]
    return records.select(F.to_json(F.struct(*keys)).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Records from lines, and the text of a line that is no log line in ``corrupt_line``.

    No line is dropped: text that is not JSON, and JSON without a readable time, level, logger and message, comes
    back as a row of nulls beside its text.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select("value", F.from_json("value", f"{_LINE_SCHEMA}, _bad string", options).alias("r"))
    rows = parsed.select("value", "r.*").withColumn("ts", F.try_to_timestamp("ts"))
    good = F.col("_bad").isNull()
    for name in ALWAYS:
        good = good & F.col(name).isNotNull()
    good = F.coalesce(good, F.lit(False))
    return rows.select(
        *[F.when(good, F.col(name)).alias(name) for name in LOG_LINE_KEYS], F.when(~good, F.col("value")).alias(CORRUPT)
    )
