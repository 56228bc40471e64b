"""Spelling variants: words one edit apart, by k-d trees over letter counts.

A word's letter counts are a point. One replaced letter moves it by one up and one down, an inserted or deleted letter by
one; so the words near a word lie within an L1 distance of two, and in trees that hold one word length each, within one
step up and one step down in the tree of its own length, one step up in that of the next length, one step down in that
of the length before. A tree halves its words at the median of the letter whose counts differ most. A search goes down
both sides only where a step it still has reaches over the border, and every leaf it comes to is compared letter by
letter.

The upper part of each tree, made from a bounded sample, deals words to cells; a cell gets the words that lie in it and
the searches that reach it, and builds the lower part. Only counts and the best neighbour of each word leave a cell, so
pairs are never written, whatever their number.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakelog.llm.components import _ends
from lakelog.llm.rows import slices, written

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
TIMES = 10
#: Words of a cell, about; words of the sample that the upper trees are made from; words of a leaf.
CELL = 1 << 13
SAMPLE = 100_000
LEAF = 32
#: Words counted in a task before they are sent on; letters compared at a time; bytes of a text read at a time.
COUNTED = 400_000
COMPARED = 1 << 21
CHUNK = 1 << 20

#: Latin-1 letters of a run, A-Z in lower case; all other bytes part runs.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_LETTER = np.array([b - 97 if 97 <= b <= 122 else b - 0xC0 + 26 if b >= 0xC0 else 0 for b in range(256)])
_KINDS = 26 + 64


# ------------------------------------------------------------------ words


def runs_of(text: str) -> Iterator[list[bytes]]:
    """Maximal runs of letters ``A-Za-z`` and U+00C0 to U+00FF, a byte each, A-Z in lower case, in bounded lists."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    begin = 0
    while begin < len(letters):
        end = len(letters) if len(letters) - begin <= CHUNK else letters.find(b" ", begin + CHUNK)
        end = len(letters) if end < 0 else end
        yield letters[begin:end].split()
        begin = end


def misspelt(doc_id: int | None, runs: list[bytes], every: int) -> list[bytes]:
    """The runs with the letter taken out that the checksum of document and run names, where ``every`` divides it."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    plain = [r if r.isascii() else r.decode("latin-1").encode() for r in runs]
    sums = np.fromiter(map(zlib.crc32, plain, repeat(seed)), np.int64, len(runs))
    for i in np.flatnonzero(sums % every == 0).tolist():
        at = int(sums[i]) % len(runs[i])
        runs[i] = runs[i][:at] + runs[i][at + 1 :]
    return runs


def words(docs: DataFrame, every: int = 31, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all whole texts and how often they occur.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null text has no words, a null id is the empty text in the
    checksum, repeated rows count again, no rows give no words. Tasks add up before they send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def send() -> pa.RecordBatch:
            names = pa.array([w.decode("latin-1") for w in counts], pa.string())
            found = pa.RecordBatch.from_arrays([names, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for some in runs_of(text or ""):
                        # Shorter runs give no words: taking a letter out only shortens them.
                        counts.update(misspelt(doc_id, [r for r in some if len(r) >= least_length], every))
                        if len(counts) >= COUNTED:
                            yield send()
        if counts:
            yield send()

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "word string, n long")
    rows = rows.filter(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return rows.filter(F.col("n") >= least_count)


# ------------------------------------------------------------------ trees


def letters_of(some: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(some), np.uint8).reshape(len(some), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    at = np.arange(len(letters))[:, None] * _KINDS + _LETTER[letters]
    counts = np.bincount(at.ravel(), minlength=len(letters) * _KINDS).reshape(len(letters), _KINDS)
    return counts.astype(np.int16 if letters.shape[1] < 1 << 14 else np.int32)


def split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter whose counts differ most and the largest count of the lower half; None if all points are equal."""
    letter = int(np.argmax(counts.var(axis=0)))
    column = np.sort(counts[:, letter])
    border = int(column[(len(column) - 1) // 2])
    if border == column[-1]:  # the median is the largest count: the border lies below it
        smaller = np.searchsorted(column, border)
        if smaller == 0:
            return None
        border = int(column[smaller - 1])
    return letter, border


class Searches:
    """Searches on their way down a tree: rows of points, and the letters a step up or down was spent on (-1: not yet).

    ``up`` and ``down`` may be -2: the search has no such step.
    """

    def __init__(self, row: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        self.row, self.up, self.down = row, up, down

    @classmethod
    def all(cls, n: int, up: bool, down: bool) -> Searches:
        return cls(np.arange(n), np.full(n, -1 if up else -2), np.full(n, -1 if down else -2))

    def sides(self, counts: np.ndarray, letter: int, border: int) -> tuple[Searches, Searches]:
        """Those that go to counts up to the border, and those that go above it."""
        x = counts[self.row, letter].astype(np.int64) + (self.up == letter) - (self.down == letter)
        below, above = x <= border, x > border
        sinks, climbs = (x == border + 1) & (self.down == -1), (x == border) & (self.up == -1)
        low = Searches(*(np.concatenate([a[below], a[sinks]]) for a in (self.row, self.up, self.down)))
        high = Searches(*(np.concatenate([a[above], a[climbs]]) for a in (self.row, self.up, self.down)))
        low.down[np.count_nonzero(below) :] = letter
        high.up[np.count_nonzero(above) :] = letter
        return low, high


#: An upper tree: a cell's number, or (letter, border, lower side, upper side).
Tree = int | tuple


def upper_tree(counts: np.ndarray, cells: int, first: int = 0) -> tuple[Tree, int]:
    """A tree of about ``cells`` cells over sampled points, and the number after its last cell."""
    border = split(counts) if cells > 1 and len(counts) > 1 else None
    if border is None:
        return first, first + 1
    low = counts[:, border[0]] <= border[1]
    left, first = upper_tree(counts[low], cells // 2, first)
    right, first = upper_tree(counts[~low], cells - cells // 2, first)
    return (*border, left, right), first


def cells_of(tree: Tree, counts: np.ndarray, searches: Searches) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell and the rows of the searches that reach it, a row at most once per cell."""
    if len(searches.row) == 0:
        return
    if isinstance(tree, int):
        yield tree, searches.row
        return
    letter, border, left, right = tree
    low, high = searches.sides(counts, letter, border)
    yield from cells_of(left, counts, low)
    yield from cells_of(right, counts, high)


def near_in_cell(
    members: np.ndarray, letters: np.ndarray, up: bool, down: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``letters``, row of ``members``) exactly one edit apart, through a k-d tree over ``members``.

    Members have the searching words' length (a step up and one down), or are one longer (up) or shorter (down).
    """
    points, counts = letter_counts(members), letter_counts(letters)
    todo = [(np.arange(len(members)), Searches.all(len(letters), up, down))]
    while todo:
        inside, searches = todo.pop()
        if len(searches.row) == 0:
            continue
        border = split(points[inside]) if len(inside) > LEAF else None
        if border is not None:
            low = points[inside, border[0]] <= border[1]
            left, right = searches.sides(counts, *border)
            todo += [(inside[low], left), (inside[~low], right)]
            continue
        step = max(1, COMPARED // (len(inside) * members.shape[1]))
        for begin in range(0, len(searches.row), step):
            rows = searches.row[begin : begin + step]
            a, b = np.nonzero(one_edit(letters[rows], members[inside]))
            if len(a):
                yield rows[a], inside[b]


def one_edit(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether each row of ``first`` and each of ``second`` differ by exactly one replaced, inserted or deleted letter."""
    a, b = first[:, None, :], second[None, :, :]
    if first.shape[1] == second.shape[1]:
        return (a != b).sum(axis=2) == 1
    if first.shape[1] > second.shape[1]:
        return one_edit(second, first).T
    # The shorter word is the longer one without a letter: what agrees from the left and from the right meets.
    left = np.logical_and.accumulate(a == b[:, :, :-1], axis=2).sum(axis=2)
    right = np.logical_and.accumulate((a == b[:, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
    return left + right >= first.shape[1]


# ------------------------------------------------------------------ the corpus


def upper_trees(found: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Tree]:
    """The upper tree of every word length, from ``sample`` words that a hash chooses. Runs jobs."""
    sizes = {r["length"]: r["n"] for r in found.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    many = [length for length, n in sizes.items() if n > cell]  # the others are one cell and need no sample
    by_length: dict[int, list[bytes]] = {length: [] for length in many}
    if many:
        share = F.pmod(F.xxhash64("word"), F.lit(total)) < sample
        chosen = found.filter(F.length("word").isin(many) & share).orderBy(F.xxhash64("word")).limit(2 * sample)
        for row in chosen.select("word").collect():
            by_length[len(row["word"])].append(row["word"].encode("latin-1"))
    return {
        length: upper_tree(letter_counts(letters_of(by_length.get(length, []), length)), -(-n // cell))[0]
        if by_length.get(length)
        else 0
        for length, n in sizes.items()
    }


#: A row of a cell. ``step``: how much longer the tree's words are than the searching word; ``home``: the word lies here.
CELLS = "length int, cell int, step int, home boolean, word string, n long"
NEAR = "word string, near long, best_n long, best string"


def dealt(found: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every word at home and wherever its searches reach."""
    names = [f.split()[0] for f in CELLS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words = np.array(batch.column("word").to_pylist(), dtype=object)
            all_n = batch.column("n").to_numpy(zero_copy_only=False)
            lengths = np.array([len(w) for w in all_words], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                some, n = all_words[rows], all_n[rows]
                counts = letter_counts(letters_of([w.encode("latin-1") for w in some], length))
                homes = np.zeros(len(some), np.int64)
                for cell, here in cells_of(trees[length], counts, Searches.all(len(some), False, False)):
                    homes[here] = cell
                for step, up, down in ((0, True, True), (1, True, False), (-1, False, True)):
                    if length + step not in trees:
                        continue
                    for cell, here in cells_of(trees[length + step], counts, Searches.all(len(some), up, down)):
                        home = homes[here] == cell if step == 0 else np.zeros(len(here), bool)
                        fixed = [np.full(len(here), v, np.int32) for v in (length + step, cell, step)]
                        columns = [*fixed, home, some[here], n[here]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return found.mapInArrow(run, CELLS)


def neighbours(cells: DataFrame) -> DataFrame:
    """Per cell and searching word that has neighbours there: how many, and the most frequent (the first if equal)."""

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length")[0].as_py()
        some = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n = table.column("n").to_numpy()
        step, home = table.column("step").to_numpy(), table.column("home").to_numpy()
        inside = np.flatnonzero(home)
        out: list[list] = [[], [], [], []]
        if len(inside):
            inside = inside[np.argsort(np.array([some[i] for i in inside], dtype=object), kind="stable")]
            members = letters_of([some[i] for i in inside], length)
            for by, up, down in ((0, True, True), (1, True, False), (-1, False, True)):
                rows = np.flatnonzero(step == by)
                if not len(rows):
                    continue
                pairs = list(near_in_cell(members, letters_of([some[i] for i in rows], length - by), up, down))
                if not pairs:
                    continue
                a, b = (np.concatenate(x) for x in zip(*pairs))
                order = np.lexsort((b, -n[inside[b]], a))
                a, b = a[order], b[order]
                firsts = np.flatnonzero(np.diff(a, prepend=-1))
                out[0] += [some[rows[i]].decode("latin-1") for i in a[firsts].tolist()]
                out[1] += np.diff(firsts, append=len(a)).tolist()
                out[2] += n[inside[b[firsts]]].tolist()
                out[3] += [some[inside[i]].decode("latin-1") for i in b[firsts].tolist()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in NEAR.split(", ")]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return cells.groupBy("length", "cell").applyInArrow(run, NEAR)


def variants(found: DataFrame, times: int = TIMES, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``found`` (``word, n``; each word once, U+00FF at most).

    ``form`` is the near word that occurs most (the first in code-point order if several do), if it occurs ``times``
    times as often as the word. Each form occurs more often than its word, so forms end in a root. No words, no rows.
    Runs jobs; words are stored in the shared folder.
    """
    found = written(found.select("word", "n"), "words")
    cells = dealt(found, upper_trees(found, cell, sample))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    near = neighbours(cells).groupBy("word").agg(F.sum("near").alias("n_near"), best)
    fits = -F.col("b.less") >= times * F.col("n")
    near = found.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("b.best")).alias("form"),
        F.when(fits, -F.col("b.less")).alias("form_n"),
    )
    near = written(near, "variants")
    has = near.filter("form is not null").select(F.col("word").alias("node"), F.col("form").alias("p"))
    ends = has.select(F.col("p").alias("node")).distinct().join(has.select("node"), "node", "left_anti")
    roots = _ends(has.unionByName(ends.select("node", F.col("node").alias("p")))).toDF("word", "root")
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among all words of a corpus."""
    return variants(words(docs))
