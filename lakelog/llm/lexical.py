"""Ranked lexical search: an inverted index with block maxima, searched by Block-Max MaxScore.

The index is cut into shards of documents. In a shard, the documents of a term stand in ascending order in blocks of
``BLOCK``, compressed to the distance from the block's first place and to as few bytes as the block needs. Beside each
block stands what bounds its scores: the pairs (occurrences, document length) that no other pair of the block beats. How
much a pair scores depends on the corpus as a whole, so the maximum of a block is exact at any later size of the corpus.

A shard answers an item with a heap of its own. The item's terms are ordered by the most they can add in the shard. The
longest run of weak terms whose bounds together cannot beat the heap's last score is non-essential: its lists give no
candidates. Candidates come from the essential lists, window by window of documents; for each weak list, strongest
first, those that cannot make it with the list's bound go, then those that cannot make it with the maximum of the block
they would be in, and only the blocks that are left are decompressed. The heaps of all shards are merged per item.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lakelog.llm.rows import slices, written

#: Documents and bytes of text after which a task begins another shard; documents of a block.
SHARD_DOCUMENTS = 1 << 15
SHARD_BYTES = 1 << 24
BLOCK = 128
#: Bytes of a text that are cut into terms at a time.
CHUNK = 1 << 20
#: Documents of the first window; each window is twice as long as the one before, up to the last.
FIRST_WINDOW, LAST_WINDOW = 256, 8192
#: Items that one pass over the index answers. A longer item set takes more passes.
ITEMS = 512
TOP = 50

INDEX = (
    "shard long, term string, df long, tokens long, last array<int>, kinds array<int>, fronts array<int>, "
    "front_tf array<int>, front_n array<long>, body binary"
)
HITS = "q long, doc_id long, score long"

#: ASCII letters and digits in lower case and all bytes of other characters; anything else parts terms.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, repeats included, in lists of bounded size."""
    text = text.translate(_TERMS)
    begin = 0
    while begin < len(text):
        end = len(text) if len(text) - begin <= CHUNK else text.find(b" ", begin + CHUNK)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


# ------------------------------------------------------------------ the index


class _Shard:
    """Documents of one shard while it is gathered."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        number = self.vocabulary.__getitem__
        parts = [np.fromiter(map(number, words), np.int32, len(words)) for words in terms_of(text) if words]
        if parts:
            self.ids.append(doc_id)
            self.terms.append(np.concatenate(parts))
            self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCUMENTS

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row per term, and one without term for the documents themselves."""
        nulls = sum(i is None for i in self.ids)
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        lengths = np.array([len(self.terms[i]) for i in order], np.int64)
        ids = np.array([self.ids[i] or 0 for i in order], np.int64)
        keys = np.concatenate([self.terms[i] for i in order]).astype(np.int64) * len(order)
        keys += np.repeat(np.arange(len(order)), lengths)
        self.terms = []
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        tf = np.diff(first, append=len(keys))
        term, doc = np.divmod(keys[first], len(order))
        packed = pack(term, doc, tf, lengths)
        tokens = len(keys)
        head = np.concatenate([[nulls], ids, lengths]).astype("<i8").tobytes()
        names = [f.split()[0] for f in INDEX.split(", ")]
        count = len(self.vocabulary)
        lists = [_with_empty(packed[name]) for name in ("last", "kinds", "fronts", "front_tf", "front_n")]
        columns = [
            pa.array(np.full(count + 1, shard)),
            pa.concat_arrays([pa.array(list(self.vocabulary), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.array(np.append(packed["df"], len(order))),
            pa.concat_arrays([pa.nulls(count, pa.int64()), pa.array([tokens], pa.int64())]),
            *lists,
            pa.concat_arrays([packed["body"], pa.array([head], pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _with_empty(column: pa.ListArray) -> pa.Array:
    return pa.concat_arrays([column, pa.array([[]], column.type)])


def pack(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> dict:
    """The lists of all terms 0, 1, 2, ... of a shard from their postings in order of term and document."""
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(begins, append=len(term))
    place = np.arange(len(term)) - np.repeat(begins, df)
    blocks = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff(blocks, append=len(term))
    block = np.repeat(np.arange(len(blocks)), sizes)
    last = doc[blocks + sizes - 1]
    base = np.where(place[blocks] == 0, 0, np.concatenate([[0], last[:-1] + 1]))
    away = doc - base[block]
    per_term = np.diff(np.searchsorted(blocks, begins), append=len(blocks))

    wide_doc, wide_tf = _width(last - base), _width(np.maximum.reduceat(tf, blocks))
    ends = np.cumsum(sizes * (wide_doc + wide_tf))
    at = np.concatenate([[0], ends[:-1]])
    body = np.zeros(int(ends[-1]), np.uint8)
    inside = np.arange(len(term)) - blocks[block]
    for values, width, start in ((away, wide_doc, at), (tf, wide_tf, at + sizes * wide_doc)):
        width, start = width[block], start[block] + inside * width[block]
        for byte in range(4):
            some = width > byte
            body[start[some] + byte] = values[some] >> 8 * byte & 255

    most = int(tf.max())
    order = np.argsort(block * (most + 1) + most - tf, kind="stable")
    key = (block * (most + 1) + most - tf)[order]
    groups = np.flatnonzero(np.diff(key, prepend=-1))
    shortest = np.minimum.reduceat(lengths[doc][order], groups)
    of_block, many = np.divmod(key[groups], most + 1)
    span = int(lengths.max()) + 1  # each block's lengths lie below those of the blocks before it
    low = np.minimum.accumulate(shortest + (len(blocks) - of_block) * span)
    front = np.flatnonzero(np.diff(low, prepend=low[0] + 1) < 0)
    fronts = np.bincount(of_block[front], minlength=len(blocks))
    per_front = np.add.reduceat(fronts, np.searchsorted(blocks, begins))

    def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    cut = np.concatenate([[0], ends[np.cumsum(per_term) - 1]]).astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cut), pa.py_buffer(body)])
    return {
        "df": df,
        "last": lists(last, per_term, pa.int32()),
        "kinds": lists(wide_doc | wide_tf << 4, per_term, pa.int32()),
        "fronts": lists(fronts, per_term, pa.int32()),
        "front_tf": lists(most - many[front], per_front, pa.int32()),
        "front_n": lists(shortest[front], per_front, pa.int64()),
        "body": bodies,
    }


def _width(values: np.ndarray) -> np.ndarray:
    """Bytes that hold each value: 1, 2 or 4."""
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents, a row per shard and term and one per shard (stored). Runs a job.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null text, and text without terms, is not in the index;
    rows of one id are documents of their own; documents without id stand first in their shard. No rows, no shards.
    """
    rows = docs.select(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.full():
                        yield shard.rows(number)
                        number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.rows(number)

    return written(rows.mapInArrow(run, INDEX), "lexical-index")


# ------------------------------------------------------------------ one shard


@dataclass(frozen=True)
class Corpus:
    """Documents that have terms, and all their terms with repeats."""

    documents: int
    tokens: int

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + 50 * n * self.documents // self.tokens

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def _part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


class Postings:
    """A term's list in a shard: bounds at hand, blocks decompressed when asked for and kept."""

    def __init__(self, row: dict, weight: int, corpus: Corpus, norms: np.ndarray) -> None:
        self.weight, self.norms, self.body = weight, norms, row["body"]
        self.last, kinds = row["last"], row["kinds"]
        self.wide_doc, self.wide_tf = kinds & 15, kinds >> 4
        self.sizes = np.full(len(self.last), BLOCK)
        self.sizes[-1] = row["df"] - BLOCK * (len(self.last) - 1)
        self.ends = np.cumsum(self.sizes * (self.wide_doc + self.wide_tf))
        parts = _part(row["front_tf"].astype(np.int64), corpus.norm(row["front_n"]))
        starts = np.concatenate([[0], np.cumsum(row["fronts"])[:-1]])
        self.most = weight * np.maximum.reduceat(parts, starts)
        self.bound = int(self.most.max())
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to their scores."""
        found = self.kept.get(b)
        if found is None:
            size, wide, end = int(self.sizes[b]), int(self.wide_doc[b]), int(self.ends[b])
            middle = end - size * int(self.wide_tf[b])
            docs = np.frombuffer(self.body, f"<u{wide}", size, middle - size * wide).astype(np.int64)
            docs += int(self.last[b - 1]) + 1 if b else 0
            tf = np.frombuffer(self.body, f"<u{int(self.wide_tf[b])}", size, middle).astype(np.int64)
            found = self.kept[b] = docs, self.weight * _part(tf, self.norms[docs])
        return found

    def window(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the window ``begin`` to ``end`` of documents that hold the term, and what it adds."""
        found = self.windows.get(begin)
        if found is None:
            low, high = np.searchsorted(self.last, [begin, end])
            parts = [self.block(b) for b in range(low, min(high + 1, len(self.last)))]
            docs = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            scores = np.concatenate([p[1] for p in parts]) if parts else docs
            low, high = np.searchsorted(docs, [begin, end])
            found = self.windows[begin] = docs[low:high] - begin, scores[low:high]
        return found

    def add(self, docs: np.ndarray, scores: np.ndarray, rest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that can still beat ``least`` with ``rest`` from weaker terms, with this term's part added."""
        at = np.searchsorted(self.last, docs)
        inside = at < len(self.last)
        most = np.where(inside, self.most[np.minimum(at, len(self.last) - 1)], 0)
        live = scores + most + rest > least
        docs, scores, at, inside = docs[live], scores[live], at[live], inside[live]
        within = int(np.count_nonzero(inside))  # candidates ascend, so those behind the last block are the last ones
        begins = np.flatnonzero(np.diff(at[:within], prepend=-1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), within]):
            members, parts = self.block(int(at[begin]))
            some = docs[begin:end]
            place = np.searchsorted(members, some)
            scores[begin:end] += np.where(members[place] == some, parts[place], 0)
        return docs, scores


def search_shard(lists: list[Postings], documents: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best documents of a shard (numbers, ascending where scores are equal) and their scores, above 0."""
    lists = sorted(lists, key=lambda x: x.bound)
    upto = np.concatenate([[0], np.cumsum([x.bound for x in lists])]).astype(np.int64)
    best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, width, least, essential = 0, FIRST_WINDOW, 0, 0
    while begin < documents:
        end = min(documents, begin + width)
        scores = np.zeros(end - begin, np.int64)
        for one in lists[essential:]:
            docs, parts = one.window(begin, end)
            scores[docs] += parts
        docs = np.flatnonzero((scores > 0) & (scores + upto[essential] > least))
        scores, docs = scores[docs], docs + begin
        for i in range(essential - 1, -1, -1):
            if not len(docs):
                break
            docs, scores = lists[i].add(docs, scores, int(upto[i]), least)
        won = scores > least
        if won.any():
            best_docs, best = np.concatenate([best_docs, docs[won]]), np.concatenate([best, scores[won]])
            order = np.lexsort((best_docs, -best))[:top]
            best_docs, best = best_docs[order], best[order]
            if len(best) == top:  # later documents of equal score come after these
                least = int(best[-1])
                essential = int(np.searchsorted(upto, least, side="right")) - 1
                if essential == len(lists):
                    break
        begin, width = end, min(2 * width, LAST_WINDOW)
    return best_docs, best


# ------------------------------------------------------------------ all shards


def _columns(table: pa.Table) -> Iterator[dict]:
    """The rows of a shard, list columns as numpy arrays."""
    table = table.combine_chunks()
    flat = {}
    for name in ("last", "kinds", "fronts", "front_tf", "front_n"):
        column = table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat[name] = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    terms, df, bodies = (table.column(c).to_pylist() for c in ("term", "df", "body"))
    for i, term in enumerate(terms):
        row = {"term": term, "df": df[i], "body": bodies[i]}
        for name, (values, offsets) in flat.items():
            row[name] = values[offsets[i] : offsets[i + 1]]
        yield row


def _answers(index: DataFrame, asked: dict[str, list[int]], corpus: Corpus, top: int) -> DataFrame:
    """The heaps of all shards for one block of items; ``asked`` has the numbers of the items that hold each term."""
    # One expression for all terms; they hold letters, digits and characters beyond ASCII only.
    wanted = F.expr("term IN ('" + "', '".join(asked) + "')")
    counted = index.filter(wanted).groupBy("term").agg(F.sum("df").alias("df")).collect()  # the terms of one block of items at most
    weights = {r["term"]: corpus.weight(r["df"]) for r in counted}

    def run(table: pa.Table) -> pa.Table:
        rows = list(_columns(table))
        head = np.frombuffer(next(r["body"] for r in rows if r["term"] is None), "<i8")
        nulls, count = int(head[0]), len(head) // 2
        ids, norms = head[1 : 1 + count], corpus.norm(head[1 + count :])
        items: dict[int, list[Postings]] = defaultdict(list)
        for row in rows:
            if row["term"] is not None and weights[row["term"]] > 0:
                postings = Postings(row, weights[row["term"]], corpus, norms)
                for q in asked[row["term"]]:
                    items[q].append(postings)
        out = [(q, *search_shard(lists, count, top)) for q, lists in items.items()]
        docs = np.concatenate([np.zeros(0, np.int64), *[d for _, d, _ in out]])
        columns = [
            pa.array(np.repeat(np.array([q for q, _, _ in out], np.int64), np.array([len(d) for _, d, _ in out], np.int64))),
            pa.array(ids[docs], pa.int64(), mask=docs < nulls),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]])),
        ]
        return pa.Table.from_arrays(columns, names=["q", "doc_id", "score"])

    needed = index.filter(wanted | F.col("term").isNull()).drop("tokens")
    return needed.groupBy("shard").applyInArrow(run, HITS)


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of every item: ``item_id, rank, doc_id, score``, scores above 0, rank from 1.

    Needs ``item_id`` and ``text``; other columns are ignored. Rows of equal id and text are one item; rows of one id
    and other texts are items that share the id, each ranked by itself. An item of null or empty text, or of terms that
    no document holds, has no rows. Equal scores rank by ascending ``doc_id``, null first. Items go through the index
    in blocks of ``ITEMS``, whose terms are all that tasks are given. Runs jobs.
    """
    items = written(items.select("item_id", "text").distinct().withColumn("q", F.monotonically_increasing_id()), "items")
    facts = index.filter("term is null").agg(F.sum("df").alias("n"), F.sum("tokens").alias("l")).first()
    answers = items.sparkSession.createDataFrame([], HITS)
    if facts["n"]:
        corpus = Corpus(facts["n"], facts["l"])
        asked: dict[str, list[int]] = defaultdict(list)
        held = 0
        for row in items.select("q", "text").toLocalIterator():
            terms = {t for words in terms_of((row["text"] or "").encode()) for t in words}
            for term in terms:
                asked[term.decode()].append(row["q"])
            held += bool(terms)
            if held == ITEMS:
                answers, asked, held = answers.union(_answers(index, dict(asked), corpus, top)), defaultdict(list), 0
        if held:
            answers = answers.union(_answers(index, dict(asked), corpus, top))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
