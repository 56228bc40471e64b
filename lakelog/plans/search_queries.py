"""Predicates, windows, lake search, naming and column audit over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.functions.predicates import window_predicate
from lakelog.operators.audit import dirty_columns as find_dirty_columns, dirty_report as report_dirty_columns
from lakelog.operators.naming import safe_names as name_safely
from lakelog.operators.scan import table_counts
from lakelog.operators.search import (
    Search,
    matched_columns as columns_by_table,
    search_lake as search_tables,
    search_one_table as search_table,
    search_summary as summarise,
    skipped_tables,
)
from lakelog.plans.inputs import TABLES, given, given_lake, instant
from lakelog.plans.registry import query
from lakelog.sinks.results import write_search
from lakelog.sinks.storage import fresh_path
from lakelog.sources.catalog import lake_columns as columns_of


def _hits(spark: SparkSession, folder: str, table: str, search: Search) -> DataFrame:
    rows = search.matching(given(spark, folder, table))
    return rows


_COUNTS = " union all ".join(f"select '{t}' as \"table\", count(*) as n from {t}" for t in TABLES)


@query(f"with c as ({_COUNTS}) select 'lake' as database, \"table\", n as rows from c")
def scan_lake_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table_counts(spark, given_lake(spark, folder))


@query(
    f"""with c as ({_COUNTS})
    select 'lake' as database, i.table_name as "table", i.column_name as "column",
      case i.data_type when 'VARCHAR' then 'string' when 'BIGINT' then 'bigint' when 'INTEGER' then 'int'
        when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' end
        as data_type,
      cast(i.ordinal_position - 1 as int) as ordinal, c.n as rows
    from information_schema.columns i join c on c."table" = i.table_name"""
)
def lake_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Every column beside the size of its table."""
    lake = given_lake(spark, folder)
    return table_counts(spark, lake).join(columns_of(spark, lake), ["database", "table"])


@query(
    """select p_partkey, p_name from part
    where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring')"""
)
def search_substring_ci(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "part", Search(("RING",))).select("p_partkey", "p_name")


@query("select doc_id from documents where contains(text, 'The') or contains(lang, 'The') or contains(source, 'The')")
def search_substring_cs(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "documents", Search(("The",), case_sensitive=True)).select("doc_id")


@query(
    """select l_orderkey, l_linenumber, l_partkey from lineitem
    where 42 in (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax)
      or contains(l_returnflag, '42') or contains(l_linestatus, '42')"""
)
def search_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "lineitem", Search(("42",))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select event_id from events where cast(ts as date) = date '2024-01-15' or contains(props, '2024-01-15')")
def search_date(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "events", Search(("2024-1-15",))).select("event_id")


@query("select doc_id from labels where toxic = 1")
def search_boolean(spark: SparkSession, folder: str) -> DataFrame:
    labels = given(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    return Search(("TRUE",)).matching(labels).select("doc_id")


@query("select vec_id, label from embeddings where vec_id = 7 or label = 7")
def search_type_skip(spark: SparkSession, folder: str) -> DataFrame:
    """The array column takes no term, and no column takes ``error``."""
    return _hits(spark, folder, "embeddings", Search(("error", "7"))).select("vec_id", "label")


@query(
    """select event_id from events
    where contains(event_type, 'error') or contains(lower(props), 'error') or cast(ts as date) = date '2024-01-15'"""
)
def search_or(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "events", Search(("error", "2024-01-15"))).select("event_id")


@query(
    """select event_id from events
    where (contains(event_type, 'error') or contains(lower(props), 'error')) and cast(ts as date) = date '2024-01-15'"""
)
def search_and(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder, "events", Search(("error", "2024-01-15"), "and")).select("event_id")


@query(
    """select cast(0 as bigint) as impossible,
      (select count(*) from embeddings where vec_id = 7 or label = 7) as possible"""
)
def search_and_impossible(spark: SparkSession, folder: str) -> DataFrame:
    """No column of the table holds a word, so AND with a word gives nothing; the number alone gives rows."""
    none = _hits(spark, folder, "embeddings", Search(("7", "word"), "AND")).agg(F.count("*").alias("impossible"))
    some = _hits(spark, folder, "embeddings", Search(("7",), "AND")).agg(F.count("*").alias("possible"))
    return none.withColumn("k", F.lit(1)).join(some.withColumn("k", F.lit(1)), "k").drop("k")


# For the SQL side: string and numeric columns per table, the first column being the key.
_STRINGS = {
    "region": "r_name",
    "nation": "n_name",
    "customer": "c_name c_mktsegment",
    "supplier": "s_name",
    "part": "p_name p_brand p_type",
    "orders": "o_orderstatus o_orderpriority",
    "lineitem": "l_returnflag l_linestatus",
    "events": "event_type props",
    "documents": "text lang source",
    "embeddings": "",
    "pages": "url html",
    "benchmark": "text",
    "labels": "",
    "conversations": "role text",
}
_NUMBERS = {
    "region": "r_regionkey",
    "nation": "n_nationkey n_regionkey",
    "customer": "c_custkey c_nationkey c_acctbal",
    "supplier": "s_suppkey s_nationkey s_acctbal",
    "part": "p_partkey p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_totalprice",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
    "events": "event_id user_id value",
    "documents": "doc_id n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn",
}
_DAYS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def sql_hits(words: list[str]) -> str:
    """``(table, row_key)`` of all rows where any word occurs, as SQL."""
    parts = []
    for table in TABLES:
        tests = []
        for word in words:
            tests += [f"contains(lower({c}), '{word.lower()}')" for c in _STRINGS[table].split()]
            if word.replace(".", "").isdigit():
                tests += [f"{c} = {word}" for c in _NUMBERS[table].split()]
            if len(word) == 10 and word[4] == "-" and table in _DAYS:
                tests.append(f"cast({_DAYS[table]} as date) = date '{word}'")
        if tests:
            key = _NUMBERS[table].split()[0]
            parts.append(
                f"select '{table}' as \"table\", cast({key} as bigint) as row_key from {table} where {' or '.join(tests)}"
            )
    return " union all ".join(parts)


@query(
    f"""with t as ({_COUNTS}), h as ({sql_hits(["BUILDING"])})
    select 'lake' as database, t."table", t."table" in ('embeddings', 'labels') as skipped,
      (select count(*) from h where h."table" = t."table") as hits
    from t"""
)
def search_skipped_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Which tables are never read, beside the hits of those that are."""
    lake, search = given_lake(spark, folder), Search(("BUILDING",), cap=None)
    name = ["database", "table"]
    skipped = skipped_tables(spark, lake, search).select(*name, F.lit(True).alias("skipped"))
    hits = summarise(spark, lake, search).select(*name, F.col("count").alias("hits"))
    listed = columns_by_table(spark, lake, search).select(*name)
    return listed.join(skipped, name, "left").join(hits, name, "left").fillna(False, ["skipped"]).fillna(0, ["hits"])


def _window(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    events = given(spark, folder, "events")
    return events.where(window_predicate(events.schema.fields, "ts", (start, end))).select("event_id")


@query("select event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-16'")
def window_closed(spark: SparkSession, folder: str) -> DataFrame:
    return _window(spark, folder, "2024-01-10", "2024-01-15")


@query("select event_id from events where ts < timestamp '2024-01-16'")
def window_open_start(spark: SparkSession, folder: str) -> DataFrame:
    return _window(spark, folder, "", "2024-01-15")


@query("select event_id from events where ts >= timestamp '2024-01-10 12:30:00'")
def window_open_end(spark: SparkSession, folder: str) -> DataFrame:
    return _window(spark, folder, "2024-01-10 12:30:00", "")


@query("select c_custkey from customer where contains(lower(c_mktsegment), 'building') or contains(lower(c_name), 'building')")
def window_missing_column(spark: SparkSession, folder: str) -> DataFrame:
    """The table has no ingestion column, so the window does not apply to it."""
    search = Search(("building",), date_range=("2024-01-10", "2024-01-15"))
    return _hits(spark, folder, "customer", search).select("c_custkey")


_MIXED = ["42", "2024-01-15"]


def _sql_columns(table: str) -> str:
    """Columns of the given table that take one of the mixed words, in schema order."""
    order = {
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "nation": "n_nationkey n_name n_regionkey",
        "region": "r_regionkey r_name",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate",
        "events": "event_id ts user_id event_type value props",
        "documents": "doc_id text lang source n_chars",
        "embeddings": "vec_id label",
        "pages": "page_id url html",
        "benchmark": "item_id text",
        "labels": "doc_id quality toxic",
        "conversations": "conv_id turn role text",
    }
    return ", ".join(order[table].split())


_COLUMN_ROWS = ", ".join(f"('{t}', '{_sql_columns(t)}')" for t in TABLES)


@query(
    f"""with c(t, cols) as (values {_COLUMN_ROWS}), h as ({sql_hits(_MIXED)})
    select 'lake' as database, c.t as "table", c.cols as matched_columns,
      (select count(*) from h where h."table" = c.t) as hits
    from c"""
)
def matched_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns any word could match, beside the rows it did match."""
    lake, search, name = given_lake(spark, folder), Search(tuple(_MIXED), cap=None), ["database", "table"]
    hits = summarise(spark, lake, search).select(*name, F.col("count").alias("hits"))
    listed = columns_by_table(spark, lake, search).withColumn("matched_columns", F.array_join("matched_columns", ", "))
    return listed.join(hits, name, "left").fillna(0, ["hits"])


@query("select event_type, props, epoch_us(ts) as ts_us from events where contains(event_type, 'error')")
def search_project_matched(spark: SparkSession, folder: str) -> DataFrame:
    search = Search(("error",), ingested_col="ts", project_matched_only=True)
    rows = _hits(spark, folder, "events", search)
    return rows.select(*[F.unix_micros(instant(F.col(c))).alias("ts_us") if c == "ts" else F.col(c) for c in rows.columns])


@query(
    """select event_id, user_id, props from events
    where contains(event_type, 'error')
      and (66 in (event_id, user_id, value) or contains(event_type, '66') or contains(props, '66'))
      and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-26'"""
)
def search_one_table(spark: SparkSession, folder: str) -> DataFrame:
    search = Search(("Error", "66"), "AND", ingested_col="ts", date_range=("2024-01-05", "2024-01-25"), cap=None)
    rows = search_table(given(spark, folder, "events"), search)
    return rows.select("event_id", "user_id", "props")


def row_key(row_json: str) -> F.Column:
    return F.regexp_extract(row_json, r'^\{"[^"]*":(-?[0-9]+)', 1).cast("long")


@query(f"select 'lake' as database, \"table\", row_key from ({sql_hits(['ring', '42', '2024-01-15'])})")
def search_lake(spark: SparkSession, folder: str) -> DataFrame:
    search = Search(("ring", "42", "2024-01-15"), cap=None)
    found = search_tables(spark, given_lake(spark, folder), search)
    return found.select("database", "table", row_key("row_json").alias("row_key"))


@query(
    f"""select 'lake' as database, "table", least(count(*), 100) as count, count(*) > 100 as truncated
    from ({sql_hits(['42'])}) group by "table" """
)
def search_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The row cap is the feature here: rows that a limit of 100 per table leaves, and whether it cut any."""
    lake, search = given_lake(spark, folder), Search(("42",), cap=100)
    name = ["database", "table"]
    kept = search_tables(spark, lake, search).groupBy(*name).agg(F.count("*").alias("count"))
    return kept.join(summarise(spark, lake, search).select(*name, "truncated"), name)


@query(
    f"""with c(t, cols) as (values {_COLUMN_ROWS}), h as (select "table" as t, count(*) as n
      from ({sql_hits(_MIXED)}) group by 1)
    select 'lake' as database, c.t as "table", c.cols as matched_columns, n as count, n as kept, false as truncated,
      concat(n, ' rows matched OR [''42'', ''2024-01-15''] in [''',
        replace(c.cols, ', ', ''', '''), ''']') as message
    from c join h on h.t = c.t"""
)
def search_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summarise(spark, given_lake(spark, folder), Search(tuple(_MIXED)))


@query(
    f"""select 'lake' as database, "table", count(*) as rows, count(*) as count, false as truncated
    from ({sql_hits(['ring'])}) group by "table" """
)
def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Write the results and read them back: rows in the files beside the count in the summary."""
    search = Search(("ring",))
    when = dt.datetime(2024, 1, 31, 12, 0, 0)
    dest = write_search(spark, given_lake(spark, folder), search, fresh_path(spark, "results"), when)
    schema = "row_json string, database string, table string"
    name = ["database", "table"]
    rows = spark.read.schema(schema).parquet(f"{dest}/matches").groupBy(*name).agg(F.count("*").alias("rows"))
    return rows.join(spark.read.parquet(f"{dest}/summary").select(*name, "count", "truncated"), name)


@query(
    r"""with n as (select p_partkey as ordinal, concat(p_brand, '/', p_type, ':', p_name) as name from part),
    c as (select *, left(translate(name, '[]:*?/\', '_______'), 31) as cleaned from n),
    p as (select *, row_number() over (partition by cleaned order by ordinal) - 1 as place from c)
    select ordinal, name, case when place = 0 then cleaned
      else concat(left(cleaned, 30 - length(cast(place as varchar))), '_', place) end as safe_name from p"""
)
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    parts = given(spark, folder, "part")
    name = F.concat("p_brand", F.lit("/"), "p_type", F.lit(":"), "p_name")
    return name_safely(parts.select(F.col("p_partkey").alias("ordinal"), name.alias("name")))


def _listed_names(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, addresses and part names as column names of a lake: three sources, whole values."""
    documents = given(spark, folder, "documents").select(
        F.lit("docs").alias("database"), F.col("source").alias("table"), F.col("text").alias("column")
    )
    pages = given(spark, folder, "pages").select(
        F.lit("web").alias("database"), F.lit("pages").alias("table"), F.col("url").alias("column")
    )
    parts = given(spark, folder, "part").select(
        F.lit("lake").alias("database"), F.col("p_brand").alias("table"), F.regexp_replace("p_name", "^small ", "small_").alias("column")
    )
    return documents.unionByName(pages).unionByName(parts)


_LISTED = r"""with l as (
    select 'docs' as database, source as "table", text as "column" from documents
    union all select 'web', 'pages', url from pages
    union all select 'lake', p_brand, regexp_replace(p_name, '^small ', 'small_') from part),
  d as (select *, array_to_string(list_sort(list_distinct(regexp_extract_all("column", '[^a-zA-Z0-9_\-]'))), '')
    as bad_chars from l)"""


@query(_LISTED + " select * from d where bad_chars <> ''")
def dirty_columns(spark: SparkSession, folder: str) -> DataFrame:
    return find_dirty_columns(_listed_names(spark, folder))


@query(
    _LISTED
    + """ select count(*) as dirty_columns, count(distinct (database, "table")) as dirty_tables
    from d where bad_chars <> ''"""
)
def dirty_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_dirty_columns(find_dirty_columns(_listed_names(spark, folder)))
