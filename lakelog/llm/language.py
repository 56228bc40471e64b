"""Language identification by fusing evidence after Bayes.

The text gives a likelihood under character trigrams of each language and of an "other" language in which all trigrams
are equally likely. The language that the markup declares and the address suffix each shift the odds by how much more
often texts with that value are in a language than texts at large. The host gives the prior, smoothed towards its
parent domain and that towards all texts. These tables come from grouped aggregates of the text evidence of all rows;
only the trigram model is fitted, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.pieces import Memory
from lakelog.llm.rows import map_texts, texts_of, written

#: Rows of each label, about, that the trigram model is fitted on.
SAMPLE = 5_000
BUCKETS = 1 << 15
#: Trigrams of a word overlap by two letters, so each counts as a third of an observation.
TEMPER = 1 / 3
#: Rows that the table above counts for in a smoothed one.
STRENGTH = 10.0
OTHER_PRIOR = 0.01
#: Below this posterior a text has no language.
LEAST = 0.5

EVIDENCE = "doc_id long, text_hash long, declared string, suffix string, host string, parent string, "


def _trigrams(word: str) -> np.ndarray:
    """Hashed trigrams of the letters of a word and its two ends."""
    letters = "".join(c for c in word if c.isalpha())
    marked = f"^{letters}$" if letters else ""
    return np.array([zlib.crc32(marked[i : i + 3].encode()) % BUCKETS for i in range(len(marked) - 2)], np.int64)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods ``[bucket, language]`` with "other" last, from ``doc_id``, ``text``, ``lang``.

    Every label is a language of the model, however rare. About ``sample`` rows of each are used, chosen by a hash; all,
    if there are fewer. Trigrams are counted on the executors; a table of language x bucket reaches the driver, where
    rows without a label leave nothing. Without labels there is only "other".
    """
    known = labelled.select("doc_id", F.lower(F.split("lang", "[-_]")[0]).alias("lang"), "text").filter("lang <> ''")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    table = np.full((BUCKETS, len(languages) + 1), 0.5)
    table[:, -1] = 1
    if not languages:
        return languages, np.log(table / table.sum(0))
    share = {lang: int(min(1.0, sample / n) * (1 << 20)) + 1 for lang, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < bound)

    def make():
        memory = Memory(lambda word: _trigrams(word).tobytes())

        def run(part: pa.RecordBatch) -> dict:
            total: dict[str, np.ndarray] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts_of(part), strict=True):
                grams = np.frombuffer(b"".join(map(memory.__getitem__, text.lower().split())), np.int64)
                total[lang] = total.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
            used = [(lang, np.flatnonzero(n), n) for lang, n in total.items()]
            return {
                "lang": [lang for lang, at, _ in used for _ in range(len(at))],
                "bucket": np.concatenate([at for _, at, _ in used]),
                "n": np.concatenate([n[at] for _, at, n in used]),
            }

        return run

    counts = map_texts(chosen, "text", make, "lang string, bucket long, n long")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    held = counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    for row in held.toLocalIterator():  # a row of at most BUCKETS pairs for each language
        table[row["at"], languages.index(row["lang"])] += row["n"]
    return languages, np.log(table / table.sum(0))


def text_evidence(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Each row's evidence columns with ``likelihood`` (log, per language and "other") and ``grams`` counted."""
    size = table.shape[1]

    def make():
        rows = np.c_[table, np.ones(len(table))]
        memory = Memory(lambda word: rows[_trigrams(word)].sum(0).tobytes())

        def run(part: pa.RecordBatch) -> dict:
            sums = [
                np.frombuffer(b"".join(map(memory.__getitem__, t.lower().split()))).reshape(-1, size + 1).sum(0)
                for t in texts_of(part)
            ]
            out = {name: part.column(name) for name in part.schema.names if name != "text"}
            return out | {"likelihood": [s[:-1].tolist() for s in sums], "grams": [int(s[-1]) for s in sums]}

        return run

    columns = [F.col(c).cast("long") if c == "doc_id" else F.col(c) for c in ("doc_id", "text_hash")]
    names = ("declared", "suffix", "host", "parent")
    rows = docs.withColumn("text_hash", F.xxhash64("text")).select(*columns, *names, "text")
    return map_texts(rows, "text", make, EVIDENCE + "likelihood array<double>, grams long")


def _sums(size: int) -> list[Column]:
    return [F.sum(F.element_at("belief", i + 1)).alias(f"n{i}") for i in range(size)]


def _smoothed(counts: DataFrame, size: int, towards: list[Column]) -> Column:
    """Shares of each language from ``n0, n1, ...``, drawn towards other shares."""
    total = sum((F.col(f"n{i}") for i in range(size)), F.lit(0.0))
    return F.array(*[(F.col(f"n{i}") + STRENGTH * towards[i]) / (total + STRENGTH) for i in range(size)])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The language of each row of ``docs``.

    Needs ``doc_id``, ``text`` and the strings ``declared`` (markup language), ``suffix`` (of the address), ``host``
    and ``parent`` (its parent domain); nulls there are no evidence, other columns are ignored. Returns ``doc_id,
    text_hash, language, probability, accepted``. A text without letters, in no modelled language, or below ``LEAST``
    is not accepted; its language is ``und``. Null text is empty; a null ``doc_id`` and repeated rows are kept, a row
    each; no rows give no rows. Runs jobs: the text evidence is written once.
    """
    languages, table = model
    size = len(languages) + 1
    evidence = written(text_evidence(docs, table), "language")
    tempered = F.transform("likelihood", lambda x: (x - F.array_max("likelihood")) * TEMPER)
    weight = F.transform(tempered, F.exp)
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    judged = evidence.filter("grams > 0").withColumn("belief", F.transform(weight, lambda x: x / total))

    overall = judged.agg(*_sums(size)).first()
    seen = [float(overall[f"n{i}"] or 0.0) for i in range(size)]
    share = [(n + 1) / (sum(seen) + size) for n in seen]
    share = [s * (1 - OTHER_PRIOR) / sum(share[:-1]) for s in share[:-1]] + [OTHER_PRIOR]
    at_large = [F.lit(s) for s in share]

    def odds(name: str) -> DataFrame:
        """How much a value shifts each language's log odds against texts at large; "other" is not shifted."""
        counts = judged.filter(F.col(name).isNotNull()).groupBy(name).agg(*_sums(size))
        near = _smoothed(counts, size, at_large)
        shift = [F.log(F.element_at(near, i + 1) / share[i]) for i in range(size - 1)]
        return counts.select(name, F.array(*shift, F.lit(0.0)).alias(f"{name}_odds"))

    parents = judged.groupBy("parent").agg(*_sums(size))
    parents = parents.select(F.col("parent").alias("_parent"), _smoothed(parents, size, at_large).alias("above"))
    hosts = judged.filter("host is not null").groupBy("host", "parent").agg(*_sums(size))
    hosts = hosts.join(parents, hosts["parent"].eqNullSafe(parents["_parent"]))
    above = [F.element_at("above", i + 1) for i in range(size)]
    prior = hosts.groupBy("host").agg(  # a host has one parent; should it have several, the first in order counts
        F.min_by(F.struct(_smoothed(hosts, size, above).alias("p")), F.coalesce("parent", F.lit(""))).alias("s")
    )
    prior = prior.select("host", F.col("s.p").alias("prior"))

    found = evidence
    for name in ("declared", "suffix"):
        found = found.join(odds(name), name, "left")
    found = found.join(prior, "host", "left")
    zeros, usual = F.array(*[F.lit(0.0)] * size), F.array(*at_large)
    scores = F.array(
        *[
            F.element_at("likelihood", i) * TEMPER
            + F.log(F.element_at(F.coalesce("prior", usual), i) if i < size else F.lit(OTHER_PRIOR))
            + F.element_at(F.coalesce("declared_odds", zeros), i)
            + F.element_at(F.coalesce("suffix_odds", zeros), i)
            for i in range(1, size + 1)
        ]
    )
    found = found.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
    spread = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in [*languages, "und"]])
    best = F.element_at(names, F.array_position("scores", F.col("top")).cast("int"))
    found = found.withColumn("probability", 1 / spread).withColumn("best", best)
    accepted = (F.col("grams") > 0) & (F.col("best") != "und") & (F.col("probability") >= LEAST)
    return found.select(
        "doc_id",
        "text_hash",
        F.when(accepted, F.col("best")).otherwise("und").alias("language"),
        F.when(F.col("grams") > 0, F.col("probability")).otherwise(0.0).alias("probability"),
        accepted.alias("accepted"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence columns of the documents table: its ``lang`` as the declared language, its ``source`` as the host."""
    nothing = F.lit(None).cast("string")
    declared = F.lower(F.split("lang", "[-_]")[0])
    return docs.select("doc_id", "text", declared.alias("declared"), nothing.alias("suffix"), F.col("source").alias("host"), nothing.alias("parent"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence columns of web pages: the ``lang`` of the markup, the last label and the last two labels of the host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    markup = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    some = lambda column: F.when(column != "", column)
    return pages.select(
        F.col("page_id").alias("doc_id"),
        text.alias("text"),
        some(F.lower(F.regexp_extract(markup, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", 1))).alias("declared"),
        some(F.substring_index(host, ".", -1)).alias("suffix"),
        some(host).alias("host"),
        some(F.substring_index(host, ".", -2)).alias("parent"),
    )


def accepted_only(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is not accepted; the model is fitted on a sample of them."""
    judged = identify(of_documents(docs), fit(docs))
    refused = written(judged.filter("not accepted").select("doc_id", "text_hash").distinct(), "refused")
    refused = refused.toDF("_id", "_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(refused["_id"]) & (F.xxhash64(docs["text"]) == refused["_hash"])
    return docs.join(refused, same, "left_anti")
