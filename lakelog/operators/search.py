"""Search for values in every table of a lake.

A lake is a mapping ``(database, table) -> DataFrame``, so catalog tables and plain files share one code path. Each
table's schema decides which columns a term can match; tables that cannot match are left out of the plan, and the
others become branches of one union that Spark schedules as one job. A lake of more than ``BRANCHES`` tables is taken in
batches of that many, several jobs side by side, so no plan grows with the lake.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakelog.functions.predicates import OR, quoted, read_cond, row_predicate, searchable_columns, window_predicate
from lakelog.functions.terms import Term
from lakelog.operators.quota import capped
from lakelog.schemas import SKIPPED_TABLES
from lakelog.sinks.storage import fresh_path

Lake = Mapping[tuple[str, str], DataFrame]

# Fixed value: the default ingestion column.
INGESTED_COL = "ingested_at"

# Tables per union of ``batches``: bounds the size of one plan. Jobs that run side by side.
BRANCHES = 64
JOBS = 8

FAILURES = (PySparkException, Py4JJavaError)
MATCHES = "database string, table string, row_json string"

TABLE_NO = "table_no"


@dataclass(frozen=True)
class Search:
    """What to look for.

    All matching rows are kept unless ``cap`` asks for at most that many per table. Which rows survive is arbitrary
    unless ``order_by`` names columns.
    """

    words: tuple[str, ...]
    cond: str = OR
    case_sensitive: bool = False
    ingested_col: str = INGESTED_COL
    date_range: tuple[str, str] = ("", "")
    project_matched_only: bool = False
    cap: int | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(self.words))
        object.__setattr__(self, "cond", read_cond(self.cond))

    @property
    def terms(self) -> list[Term]:
        return [Term.read(word) for word in self.words]

    def predicate(self, df: DataFrame) -> Column | None:
        return row_predicate(df.schema.fields, self.terms, self.cond, self.case_sensitive)

    def columns(self, df: DataFrame) -> list[str]:
        return searchable_columns(df.schema.fields, self.terms)

    def matching(self, df: DataFrame) -> DataFrame | None:
        """All matching rows of one table, uncapped; None when no term can match any of its columns.

        Also the standing search: a stateless filter, so ``df`` may be a stream.
        """
        predicate = self.predicate(df)
        if predicate is None:
            return None
        window = window_predicate(df.schema.fields, self.ingested_col, self.date_range)
        rows = (df if window is None else df.where(window)).where(predicate)
        keep = self.columns(df) if self.project_matched_only else []
        if not keep:
            return rows
        if self.ingested_col in df.columns and self.ingested_col not in keep:
            keep.append(self.ingested_col)
        return rows.select(*[quoted(name) for name in keep])

    def limited(self, rows: DataFrame, columns: tuple[Column, ...] = ()) -> tuple[DataFrame, bool]:
        """The rows within the cap, and whether it cut any. With a cap, runs jobs that read the rows once."""
        if self.cap is None:
            return (rows.select(*columns) if columns else rows), False
        return capped(rows, self.cap, [quoted(name) for name in self.order_by], columns)


def search_one_table(df: DataFrame, search: Search) -> DataFrame | None:
    """The matching rows of one table with their own columns, at most ``cap`` of them."""
    rows = search.matching(df)
    return None if rows is None else search.limited(rows)[0]


def _json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"}).alias("row_json")


def _row_json(rows: DataFrame) -> Column:
    return _json(F.struct(*[quoted(c) for c in rows.columns]))


def union_all(spark: SparkSession, parts: list[DataFrame], columns: str) -> DataFrame:
    """The parts as one DataFrame, joined pairwise; an empty one of these columns when there are none."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else spark.createDataFrame([], columns)


def _searched(lake: Lake, search: Search) -> dict[tuple[str, str], DataFrame]:
    matching = {name: search.matching(df) for name, df in lake.items()}
    return {name: rows for name, rows in matching.items() if rows is not None}


def search_lake(spark: SparkSession, lake: Lake, search: Search) -> DataFrame:
    """Matching rows of every table as ``(database, table, row_json)``, all of them unless the search has a cap.

    One lazy union for up to ``BRANCHES`` tables and no cap. Otherwise it runs the jobs of ``search_large_lake``, and
    the first table that cannot be searched is an error.
    """
    if search.cap is None and len(lake) <= BRANCHES:
        return union_all(spark, _branches(lake, search), MATCHES)
    matches, failed = search_large_lake(spark, lake, search)
    first = failed.first()
    if first is not None:
        raise RuntimeError(f"{first['database']}.{first['table']}: {first['reason']}")
    return matches


def _branches(lake: Lake, search: Search) -> list[DataFrame]:
    return [table_matches(name, rows) for name, rows in _searched(lake, search).items()]


def in_batches(
    lake: Lake, work: Callable[[Lake], object], size: int = BRANCHES, jobs: int = JOBS
) -> tuple[list, list[tuple[str, str, str]]]:
    """What ``work`` gives for batches of the lake, ``jobs`` of them at a time, and the tables that failed.

    The tables of a batch that fails are tried one by one, so only those at fault are missing, each with its reason.
    """

    def attempt(part: Lake) -> tuple[list, list]:
        try:
            return [work(part)], []
        except FAILURES as error:
            if len(part) == 1:
                (name,) = part
                return [], [(*name, str(error).splitlines()[0])]
        alone = [attempt({name: part[name]}) for name in part]
        return [r for results, _ in alone for r in results], [f for _, failed in alone for f in failed]

    with ThreadPoolExecutor(jobs) as pool:
        done = list(pool.map(attempt, batches(lake, size)))
    return [r for results, _ in done for r in results], [f for _, failed in done for f in failed]


def search_large_lake(
    spark: SparkSession, lake: Lake, search: Search, jobs: int = JOBS
) -> tuple[DataFrame, DataFrame]:
    """The matches of a lake of any number of tables as one stored result, and the tables that could not be searched.

    Each job searches up to ``BRANCHES`` tables (one, with a cap) and writes its matches to the shared folder.
    """
    folder = fresh_path(spark, "matches")

    def work(part: Lake) -> str | None:
        if search.cap is None:
            branches = _branches(part, search)
        else:
            branches = [
                search.limited(rows, table_columns(name, rows))[0] for name, rows in _searched(part, search).items()
            ]
        if not branches:
            return None
        path = fresh_path(spark, "part").rsplit("/", 1)[-1]
        union_all(spark, branches, MATCHES).write.parquet(f"{folder}/{path}")
        return f"{folder}/{path}"

    paths, failed = in_batches(lake, work, BRANCHES if search.cap is None else 1, jobs)
    paths = [p for p in paths if p is not None]
    matches = spark.read.schema(MATCHES).parquet(*paths) if paths else spark.createDataFrame([], MATCHES)
    return matches, spark.createDataFrame(failed, SKIPPED_TABLES)


def with_messages(spark: SparkSession, lake: Lake, search: Search, counts: DataFrame) -> DataFrame:
    """Turn ``(table_no, count, kept, truncated, more)`` into summary rows; ``more``: the count is a lower bound."""
    facts = []
    for number, ((db, table), df) in enumerate(lake.items()):
        columns = search.columns(df)
        facts.append(
            (number, db, table, ", ".join(columns), f" rows matched {search.cond} {list(search.words)} in {columns}")
        )
    about = spark.createDataFrame(facts, f"{TABLE_NO} int, database string, table string, matched_columns string, tail string")
    message = F.concat(
        F.col("count").cast("string"),
        F.when(F.col("more"), "+").otherwise(""),
        "tail",
        F.when(F.col("truncated"), " (truncated)").otherwise(""),
    )
    named = counts.join(about, TABLE_NO)
    return named.select("database", "table", "matched_columns", "count", "kept", "truncated", message.alias("message"))


def search_summary(spark: SparkSession, lake: Lake, search: Search) -> DataFrame:
    """One row per table that matched: all its matches counted, how many a cap keeps, and a message.

    Counts the matches where they are read and shuffles one number per table and task; the cap is arithmetic on the
    count, so no rows are moved to apply it.
    """
    numbers = {name: i for i, name in enumerate(lake)}

    def counted(part: Lake) -> DataFrame:
        parts = [rows.select(F.lit(numbers[name]).alias(TABLE_NO)) for name, rows in _searched(part, search).items()]
        return union_all(spark, parts, f"{TABLE_NO} int").groupBy(TABLE_NO).agg(F.count("*").alias("count"))

    if len(lake) <= BRANCHES:
        counts = counted(lake)
    else:
        # A number per table, from jobs of bounded size; a table that cannot be read is an error, as in one plan.
        found, failed = in_batches(lake, lambda part: counted(part).collect())
        if failed:
            raise RuntimeError(f"{failed[0][0]}.{failed[0][1]}: {failed[0][2]}")
        rows = [(r[TABLE_NO], r["count"]) for some in found for r in some]
        counts = spark.createDataFrame(rows, f"{TABLE_NO} int, count long")
    kept = F.col("count") if search.cap is None else F.least("count", F.lit(search.cap).cast("long"))
    counts = counts.select("*", kept.alias("kept"), F.lit(False).alias("more"))
    return with_messages(spark, lake, search, counts.withColumn("truncated", F.col("kept") < F.col("count")))


def matched_columns(spark: SparkSession, lake: Lake, search: Search) -> DataFrame:
    """Columns any term could match, per table, in schema order. Looks at schemas only."""
    rows = [(db, table, search.columns(df)) for (db, table), df in lake.items()]
    return spark.createDataFrame(rows, "database string, table string, matched_columns array<string>")


def skipped_tables(spark: SparkSession, lake: Lake, search: Search) -> DataFrame:
    """Tables that no term can match, which are never read. Looks at schemas only."""
    rows = [
        (db, table, "no column takes any term") for (db, table), df in lake.items() if search.predicate(df) is None
    ]
    return spark.createDataFrame(rows, SKIPPED_TABLES)


def batches(lake: Lake, size: int = BRANCHES) -> Iterator[Lake]:
    """The lake in parts of at most ``size`` tables."""
    names = iter(lake)
    while part := list(islice(names, size)):
        yield {name: lake[name] for name in part}


def table_columns(name: tuple[str, str], rows: DataFrame) -> tuple[Column, Column, Column]:
    """The columns of a table's matches: where they are from, and the row as JSON."""
    return F.lit(name[0]).alias("database"), F.lit(name[1]).alias("table"), _row_json(rows)


def table_matches(name: tuple[str, str], rows: DataFrame) -> DataFrame:
    """Matching rows of one table as ``(database, table, row_json)``."""
    return rows.select(*table_columns(name, rows))
