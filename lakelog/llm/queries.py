"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelog.llm import bpe, embeddings, html, language, lexical, lm, minhash, packing, pii, simhash, spelling, token_files, warc
from lakelog.llm.rows import table
from lakelog.sinks.storage import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The vocabulary in its two forms; operators take the path as a parameter.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: The id that ends a document in token files.
END_ID = 1


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, folder, "documents"))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


@query
def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, keep_ids=False).drop("ids")


@query
def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages")).drop("url")


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(language.of_documents(docs), language.fit(docs)).drop("text_hash")


@query
def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by all evidence: declared markup language, address suffix, host and its parent domain."""
    pages = language.of_pages(table(spark, folder, "pages"))
    found = language.identify(pages, language.fit(table(spark, folder, "documents")))
    return found.withColumnRenamed("doc_id", "page_id").drop("text_hash")


@query
def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_documents(table(spark, folder, "documents"))


@query
def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_files.write_and_read(docs, WORDS, fresh_path(spark, "tokens"), END_ID)


@query
def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


ORACLE["op6_embeddings"] = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (
  select vec_id, vec_id as other from v
  union
  select r.vec_id, l.b from reach r join links l on l.a = r.other),
least as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a, count(*) as n from links group by a)
select l.vec_id, coalesce(n.n, 0) as n_links, l.component_id, l.vec_id = l.component_id as kept
from least l left join n on n.a = l.vec_id
"""

ORACLE["op8_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select html, max(page_id) as keeper from p where strlen(html) >= 1000 group by html),
j as (select p.page_id, p.html, case when p.page_id < k.keeper then k.keeper end as refers_to
  from p left join k on p.html = k.html)
select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from j
"""

# Fixed value: what parts two terms is any ASCII character that is neither letter nor digit.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_lexical"] = f"""
with t as (
  select doc_id, term, count(*) as tf
  from (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from documents) group by doc_id, term),
n as (select doc_id, cast(sum(tf) as bigint) as n from t group by doc_id),
c as (select count(*) as docs, cast(sum(n) as bigint) as tokens from n),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from t group by term), c),
i as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark),
s as (
  select item_id, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // tokens)))) as bigint) as score
  from i join t using (term) join n using (doc_id) join w using (term), c group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from s where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from r where place <= 50
"""
