"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words and an end. Each is written in bits: frequent words, the end and an escape by a Huffman code, the
bytes of other words and their terminator by another. Three predictors see each bit, by its place in the code together
with no, one or two words before it (in a spelled word: one, two or three bytes). A predictor is a table of hashed slots
with the zeros and ones that the training texts have there. Their log odds are mixed with weights that a gate picks
(kind of code and depth in it). Weights begin as learned on all training texts and follow the text: they, and a final
adaptive refinement of the mixed probability, are updated after each round of a text, and rounds grow from 16 tokens.
Every bit is predicted from what comes before it only, so the product of the predictions is a probability.

The base score needs the count of every word. Those of the frequent words are at hand; the other words are joined with
the table of counts, whose keys are then all rare.

What reaches the driver is bounded: at most ``WORDS`` words, ``3 << SLOT_BITS`` slots, 256 byte counts.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lakelog.llm.rows import slices, texts_of, written

#: Most words with a code of their own, and the longest of them in bytes.
WORDS = (1 << 17) - 4
LONGEST = 64
SLOT_BITS = 18
PASSES = 2
#: Most tokens of a text in a round, and of all texts of a block.
ROUND = 4096
BLOCK = 32_768
#: Characters of texts scored together; their bits take far more memory.
SCORED_CHARS = 1 << 19
SCORED_ROWS = 256
#: Characters and rows whose words are counted, or looked up, at once.
COUNTED_CHARS, COUNTED_ROWS = 1 << 23, 1 << 13
LOOKED_UP_CHARS, LOOKED_UP_ROWS = 1 << 22, 1 << 12
_RATE = 0.02
_RESIST = 32.0  # bits that the refinement's starting point counts for
_GATES = 32
_CELLS = 24
_PRIOR = 0.4

SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "bits_per_byte double"
)


def is_held_out(doc_id: Column) -> Column:
    """Rows that are not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``words_of`` gives for a column of texts, as one array, and how many words each text has."""
    fresh = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # ascii_lower misreads a cast slice
    cut = pc.ascii_split_whitespace(pc.ascii_lower(fresh))
    words = cut.flatten().cast(pa.large_binary())
    real = pc.greater(pc.binary_length(words), 0)
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return words.filter(real), np.diff(before[cut.offsets.to_numpy() - cut.offsets[0].as_py()])


# ------------------------------------------------------------------ counts


def count_tokens(docs: DataFrame) -> DataFrame:
    """``word binary, c``: how often each word occurs in ``text``; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNTED_CHARS, COUNTED_ROWS):
                found = split_words(part.column("text"))[0].value_counts()
                words = pa.concat_arrays([found.field("values"), pa.array([b""], pa.large_binary())])
                counts = pa.concat_arrays([found.field("counts"), pa.array([len(part)], pa.int64())])
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), counts], names=["word", "c"])

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The least count with at most ``WORDS`` words at or above it, and those words.

    Words that occur once are never among them, so spelling and escapes are learned however small the vocabulary is; the
    end always is.
    """
    step = np.log(1.02)
    end = F.length("word") == 0
    short = counts.filter((F.length("word") <= LONGEST) & ((F.col("c") >= 2) | end))
    sizes = short.groupBy(F.floor(F.log("c") / step).alias("level")).agg(F.min("c").alias("c"), F.count("*").alias("n"))
    least, total = 1 << 62, 0
    for row in sizes.orderBy(F.desc("level")).collect():
        total += row["n"]
        if total > WORDS:
            break
        least = row["c"]
    rows = short.filter((F.col("c") >= least) | end).toPandas()
    return least, {bytes(w): int(c) for w, c in zip(rows["word"], rows["c"], strict=True)}


# ------------------------------------------------------------------ codes


_MASK = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint32(0x9E3779B1)


class Code:
    """A Huffman code: per symbol, the inner nodes on its path and the bits taken there.

    ``packed`` holds node, gate and bit of a place in one number; gates go by depth, from ``gate`` on.
    """

    def __init__(self, weights: np.ndarray, gate: int = 0) -> None:
        n = len(weights)
        heap = [(int(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, bit = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            bit[y] = 1
            heapq.heappush(heap, (a + b, node))
        root = 2 * n - 2
        at, nodes, bits, lengths = np.arange(n), [], [], np.zeros(n, np.int64)
        while (going := at != root).any():
            nodes.append(np.where(going, root - parent[at], -1))
            bits.append(np.where(going, bit[at], 0))
            lengths += going
            at = np.where(going, parent[at], root)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.nodes, self.bits = np.zeros(lengths.sum(), np.int32), np.zeros(lengths.sum(), np.int8)
        depths = (np.arange(lengths.sum()) - np.repeat(self.starts, lengths)).astype(np.int32)
        for step in range(len(nodes)):  # from the leaf upwards, so the last bit comes first
            has = lengths > step
            place = self.starts[has] + lengths[has] - 1 - step
            self.nodes[place], self.bits[place] = nodes[step][has], bits[step][has]
        gates = gate + np.minimum(depths, _GATES // 2 - 1)
        self.packed = self.nodes * np.int32(2 * _GATES) + gates * 2 + self.bits

    def places(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each symbol has, and where each bit of all symbols in order is in the code's arrays."""
        lengths = self.lengths[symbols]
        begin = np.cumsum(lengths)
        total = int(begin[-1]) if len(begin) else 0
        return lengths, np.repeat(self.starts[symbols] - begin + lengths, lengths) + np.arange(total)


def _hash(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(parts[0]), np.uint64)
        for part in parts:
            out = (out ^ part.astype(np.uint64)) * _MASK
            out ^= out >> np.uint64(29)
    return out


def _slots(context: np.ndarray, lengths: np.ndarray, key: np.ndarray, bits: int, base: int) -> np.ndarray:
    """Slots of the bits of symbols in their contexts; ``key`` is the spread number of each bit's node."""
    mixed = np.repeat((context >> np.uint64(32)).astype(np.uint32), lengths)
    mixed ^= key
    mixed *= _SPREAD
    mixed >>= np.uint32(32 - bits)
    mixed += np.uint32(base)
    return mixed.view(np.int32)


def _spread(nodes: np.ndarray) -> np.ndarray:
    return (nodes.view(np.uint32) + np.uint32(1)) * _SPREAD


class Coder:
    """Turns tokens into bits with the slots that the predictors use for them."""

    def __init__(self, frequent: dict[bytes, int], total: int, letters: np.ndarray) -> None:
        ordered = sorted(frequent.items(), key=lambda x: (-x[1], x[0]))
        self.symbol = {w: i for i, (w, _) in enumerate(ordered)}
        if b"" not in self.symbol:
            self.symbol[b""] = len(self.symbol)
            ordered.append((b"", 1))
        self.escape = len(ordered)
        self.counts = np.array([frequent.get(w, 0) for w, _ in ordered] + [0], np.int64)
        self.unlisted = total - sum(frequent.values())
        self.words = Code(np.array([max(1, c) for _, c in ordered] + [max(1, self.unlisted)], np.int64))
        self.letters = Code(np.maximum(1, letters), _GATES // 2)

    @cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.symbol), pa.large_binary())

    def symbols_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The symbols of each text of a column, its end included."""
        words, lengths = split_words(texts)
        found = pc.fill_null(pc.index_in(words, value_set=self.listed), self.escape).to_numpy()
        ends = np.cumsum(lengths)
        tokens = np.insert(found.astype(np.int64), ends, self.symbol[b""])
        return np.split(tokens, (ends + np.arange(1, len(ends) + 1))[:-1])

    def word_bits(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones that the training texts have at each node of the words' code: the first predictor's slots."""
        weight = np.repeat(np.r_[self.counts[:-1], self.unlisted], self.words.lengths[: self.escape + 1])
        sums = np.bincount(2 * self.words.nodes + self.words.bits, weight, minlength=2 << SLOT_BITS).astype(np.int64)
        return sums[::2], sums[1::2]

    def symbols(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.symbol.get, tokens, repeat(self.escape)), np.int64, len(tokens))

    def bits(self, symbols: np.ndarray, spell: Callable[[int], bytes], owner: np.ndarray, before: np.ndarray) -> tuple:
        """Bits of a run of tokens: owner and gate as one number, slots of each predictor, bit.

        ``spell`` gives the word at a place, ``owner`` the text of each token; texts are runs. ``before[text]`` has the two symbols before the run.
        The bits of spelled words follow those of all words: bits of a round are not told apart by their order.
        """
        size = 1 << SLOT_BITS
        first = np.r_[True, owner[1:] != owner[:-1]]
        start = np.flatnonzero(first)
        one = np.r_[0, symbols[:-1]]
        two = np.r_[0, one[:-1]]
        one[start], two[start] = before[owner[start], 0], before[owner[start], 1]
        second = start[start + 1 < len(symbols)] + 1
        second = second[~first[second]]
        two[second] = before[owner[second], 0]

        lengths, at = self.words.places(symbols)
        packed, text = self.words.packed.take(at), owner * _GATES
        gate = np.repeat(text, lengths)
        gate += packed >> 1 & _GATES - 1
        nodes, bit = packed // (2 * _GATES), packed & 1
        key = _spread(nodes)
        slots = [
            nodes,
            _slots(_hash(one + 1), lengths, key, SLOT_BITS, size),
            _slots(_hash(one + 1, two + 7), lengths, key, SLOT_BITS, 2 * size),
        ]
        rare = np.flatnonzero(symbols == self.escape)
        if not len(rare):
            return gate, slots, bit

        spelled = [spell(i) + b" " for i in rare.tolist()]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        letters = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
        within = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        b1, b2, b3 = (np.where(within >= k, np.r_[np.zeros(k, np.int64), letters[:-k]][: len(letters)], 0) for k in (1, 2, 3))
        lengths, at = self.letters.places(letters)
        packed = self.letters.packed.take(at)
        key = _spread(packed // (2 * _GATES))
        more = [
            _slots(_hash(b1 + 300), lengths, key, SLOT_BITS - 1, size // 2),
            _slots(_hash(b1, b2 + 300), lengths, key, SLOT_BITS, size),
            _slots(_hash(b1, b2, b3 + 300), lengths, key, SLOT_BITS, 2 * size),
        ]
        more_gate = np.repeat(np.repeat(text[rare], sizes), lengths)
        more_gate += packed >> 1 & _GATES - 1
        return (
            np.concatenate([gate, more_gate]),
            [np.concatenate(pair) for pair in zip(slots, more, strict=True)],
            np.concatenate([bit, packed & 1]),
        )


# ------------------------------------------------------------------ predictors


def count_slots(docs: DataFrame, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of all slots over ``docs``. A task adds its texts up before anything is shuffled."""
    slots = 3 << SLOT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * slots, np.int64)
        for batch in batches:
            for part in slices(batch, "text", LOOKED_UP_CHARS, LOOKED_UP_ROWS):
                texts = [[*words_of(t), b""] for t in texts_of(part)]
                for tokens, symbols, owner in _blocks(texts, coder.symbols_of(part.column("text"))):
                    none = np.zeros((owner[-1] + 1, 2), np.int64)
                    _, at, bit = coder.bits(symbols, tokens.__getitem__, owner, none)
                    known = int(coder.words.lengths[symbols].sum())  # these bits of the first predictor are in the word counts
                    at[0] = at[0][known:]
                    for i, row in enumerate(at):
                        own = counts[2 * i << SLOT_BITS : 2 * (i + 1) << SLOT_BITS]
                        own += np.bincount(2 * (row - np.int32(i << SLOT_BITS)) + bit[-len(row) or len(bit) :], minlength=len(own))
        used = np.flatnonzero(counts[::2] + counts[1::2])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[2 * used]), pa.array(counts[2 * used + 1])],
            names=["slot", "n0", "n1"],
        )

    sums = docs.select("text").mapInArrow(run, "slot int, n0 long, n1 long").groupBy("slot")
    stored = written(sums.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "slots")
    zeros, ones = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for part in range(3):  # a third at a time, to spare the driver
        rows = stored.filter((F.col("slot") >= part << SLOT_BITS) & (F.col("slot") < part + 1 << SLOT_BITS)).toPandas()
        zeros[rows["slot"]], ones[rows["slot"]] = rows["n0"], rows["n1"]
    for whole, own in zip((zeros, ones), coder.word_bits(), strict=True):
        whole[: 1 << SLOT_BITS] += own
    return zeros, ones


def _blocks(
    texts: list[list[bytes]], symbols: list[np.ndarray]
) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Tokens of several texts, or of a piece of one, with symbols and owners; at most ``BLOCK`` tokens, more or less."""
    tokens, held, owner, n = [], [], [], 0
    for text, own in zip(texts, symbols, strict=True):
        for i in range(0, len(text), BLOCK):
            tokens += text[i : i + BLOCK]
            held.append(own[i : i + BLOCK])
            owner.append(np.full(len(held[-1]), n))
            n += 1
            if len(tokens) >= BLOCK:
                yield tokens, np.concatenate(held), np.concatenate(owner)
                tokens, held, owner, n = [], [], [], 0
    if tokens:
        yield tokens, np.concatenate(held), np.concatenate(owner)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Mixes log odds by gated weights and refines the result, for many texts side by side."""

    def __init__(self, weights: np.ndarray, texts: int) -> None:
        self.weights = np.tile(weights.T, texts).astype(np.float32)  # predictor, then text and gate
        self.texts = texts
        self.hits = np.zeros((3, texts * _CELLS))  # bits, ones among them, ones expected

    def round(self, gate: np.ndarray, odds: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """Log2 probability that each text gives the bits of a round, by what the rounds before have taught."""
        n = self.texts
        mixed = sum(w.take(gate) * o for w, o in zip(self.weights, odds, strict=True))
        owner = gate // _GATES
        level = mixed * 2
        level += np.float32(_CELLS / 2)
        np.clip(level, 0, _CELLS - 1, out=level)
        cell = owner * _CELLS
        cell += level.astype(np.int32)
        bits, ones, expected = self.hits
        shift = np.log((ones + _RESIST / 2) / (bits - ones + _RESIST / 2)) - np.log(
            (expected + _RESIST / 2) / (bits - expected + _RESIST / 2)
        )
        final = shift.astype(np.float32).take(cell)
        final += mixed
        p = _logistic(np.clip(mixed, -30, 30, out=mixed))
        taken = bit.astype(np.float32)
        error = taken - p
        seen = np.sqrt(np.maximum(1, np.bincount(gate, minlength=n * _GATES)))
        for weight, odd in zip(self.weights, odds, strict=True):
            weight += (_RATE * np.bincount(gate, error * odd, minlength=n * _GATES) / seen).astype(np.float32)
        expected += np.bincount(cell, p, minlength=n * _CELLS)
        cell *= 2
        cell += bit
        zero_one = np.bincount(cell, minlength=2 * n * _CELLS).reshape(-1, 2)
        bits += zero_one.sum(1)
        ones += zero_one[:, 1]
        np.clip(final, -15, 15, out=final)
        final *= 1 - 2 * taken
        return -np.bincount(owner, np.log2(1 + np.exp(final)), minlength=n)


def score_texts(
    texts: list[list[bytes]], symbols: list[np.ndarray], coder: Coder, odds: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Log2 probability of each text (its tokens with the end), independent of the texts beside it."""
    mixer, out = Mixer(weights, len(texts)), np.zeros(len(texts))
    before = np.zeros((len(texts), 2), np.int64)
    at, size = 0, 16
    live = list(range(len(texts)))
    while live:
        runs = [symbols[i][at : at + size] for i in live]
        lengths = np.array([len(r) for r in runs])
        owner, ends = np.repeat(live, lengths), np.cumsum(lengths)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + at

        def spell(i: int, owner=owner, place=place) -> bytes:
            return texts[owner[i]][place[i]]

        gate, slots, bit = coder.bits(np.concatenate(runs), spell, owner, before)
        out += mixer.round(gate, [odds.take(s) for s in slots], bit)
        for i, run in zip(live, runs, strict=True):
            before[i] = (run[-1], run[-2] if len(run) > 1 else before[i, 0])
        at += size
        live = [i for i in live if len(texts[i]) > at]
        size = min(ROUND, 2 * size)
    return out


def learn_weights(texts: list[list[bytes]], coder: Coder, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Gated weights after online passes over texts, each seen without its own share in the counts.

    A longer text takes part in pieces of ``ROUND`` tokens, each after the two tokens before it.
    """
    facts = [_facts(run, coder.symbols(run), before, coder, zeros, ones) for run, before in _pieces(texts, coder)]
    weights = np.full((_GATES, 3), 0.4)
    for _ in range(PASSES):
        for fact in facts:
            _update(weights, *fact)
    return weights


def _facts(
    run: list[bytes], symbols: np.ndarray, before: np.ndarray, coder: Coder, zeros: np.ndarray, ones: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Gates, each predictor's log odds without the piece's own share in the counts, and the bits of a piece."""
    alone = np.zeros(len(run), np.int64)
    gate, slots, bit = coder.bits(symbols, run.__getitem__, alone, before)
    odds = []
    for row in slots:
        used, place = np.unique(row, return_inverse=True)
        own1 = np.bincount(place, bit)
        own0 = np.bincount(place) - own1
        n1, n0 = np.maximum(0, ones[used] - own1), np.maximum(0, zeros[used] - own0)
        odds.append(np.log((n1 + _PRIOR) / (n0 + _PRIOR))[place])
    return gate, odds, bit


def _update(weights: np.ndarray, gate: np.ndarray, odds: list[np.ndarray], bit: np.ndarray) -> None:
    """One online step of the weights, in place, over the bits of a piece."""
    error = bit - _logistic(sum(weights[gate, i] * odds[i] for i in range(len(odds))))
    seen = np.maximum(1, np.bincount(gate, minlength=_GATES))
    for i in range(len(odds)):
        weights[:, i] += _RATE * np.bincount(gate, error * odds[i], minlength=_GATES) / np.sqrt(seen)


def learned_weights(training: DataFrame, coder: Coder, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Gated weights learned on every training text, as ``learn_weights`` learns them, by all tasks at once.

    A task takes its texts in the slices that are scored together; the bits of a slice are made once and the weights pass ``PASSES`` times over
    them, online. The weights are the tasks' mean, each by the bits it saw. Only ``_GATES * 3`` sums a task reach the
    driver.
    """
    start = np.full((_GATES, 3), 0.4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, bits = start.copy(), 0
        for batch in batches:
            for part, symbols in _parts(batch, coder):
                texts = [[*words_of(t), b""] for t in texts_of(part)]
                pieces = _symbol_pieces(texts, symbols)
                facts = [_facts(run, symbols, before, coder, zeros, ones) for run, symbols, before in pieces]
                for _ in range(PASSES):
                    for fact in facts:
                        _update(mine, *fact)
                bits += sum(len(fact[2]) for fact in facts)
        cells = np.arange(mine.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(mine.ravel() * bits), pa.array(np.full(mine.size, bits, np.int64))],
            names=["cell", "w", "bits"],
        )

    sums = training.select("text").mapInArrow(run, "cell long, w double, bits long").groupBy("cell")
    total = sums.agg(F.sum("w").alias("w"), F.sum("bits").alias("bits")).collect()
    if not total or total[0]["bits"] == 0:
        return start
    out = np.empty(start.size)
    for row in total:
        out[row["cell"]] = row["w"] / row["bits"]
    return out.reshape(start.shape)


def _symbol_pieces(texts: list[list[bytes]], symbols: list[np.ndarray]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """As ``_pieces``, with the symbols of each piece, taken from those of whole texts."""
    for tokens, coded in zip(texts, symbols, strict=True):
        before = np.zeros((1, 2), np.int64)
        for at in range(0, len(tokens), ROUND):
            yield tokens[at : at + ROUND], coded[at : at + ROUND], before
            before = coded[at : at + ROUND][-2:][::-1][None]


def _pieces(texts: list[list[bytes]], coder: Coder) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """All texts in pieces of ``ROUND`` tokens at most, with the two symbols before each, the nearer first."""
    for tokens in texts:
        before = np.zeros((1, 2), np.int64)
        for at in range(0, len(tokens), ROUND):
            yield tokens[at : at + ROUND], before
            before = coder.symbols(tokens[at : at + ROUND][-2:])[::-1][None]


# ------------------------------------------------------------------ the operator


def score_documents(docs: DataFrame, held_out: Callable[[Column], Column] = is_held_out) -> DataFrame:
    """Score every whole text by a unigram base and by the mixing model, both learned from the rows not held out.

    Needs ``doc_id`` and ``text``; other columns are ignored. ``n_tokens`` counts words and the end, ``n_known`` those
    that occur in training, ``score`` is the model's log10 probability of the tokens, ``bits_per_byte`` the same per
    byte of the text (null for empty ones). A null text is empty: its end alone. A null ``doc_id`` is learned from; repeated rows
    are kept, a row each; no rows give no rows. Without training rows counts are 0. Runs jobs; counts, the model's
    slots and the scored rows are gathered over all rows.
    """
    rows = docs.select(docs["doc_id"].cast("long"), docs["text"], held_out(docs["doc_id"]).alias("held_out"))
    training = rows.filter("not held_out")
    counts = written(count_tokens(training), "counts")
    facts = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = int(facts["n"] or 0), int(facts["v"])
    _, frequent = _frequent(counts)
    coder = Coder(frequent, train_tokens, _letters(counts, frequent))
    zeros, ones = count_slots(training, coder)
    weights = learned_weights(training, coder, zeros, ones)
    odds = np.log((ones + _PRIOR) / (zeros + _PRIOR)).astype(np.float32)
    known = np.log10(coder.counts + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each of its words that is not frequent (``word`` is not null)."""
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "word"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, symbols in _parts(batch, coder):
                texts = [[*words_of(t), b""] for t in texts_of(part)]
                logs = score_texts(texts, symbols, coder, odds, weights) * np.log10(2)
                columns: list[list] = [[] for _ in names]
                for i, (tokens, at) in enumerate(zip(texts, symbols, strict=True)):
                    rare = Counter(tokens[j] for j in np.flatnonzero(at == coder.escape).tolist())
                    own = [row, part["doc_id"][i].as_py(), part["held_out"][i].as_py(), len(tokens),
                           int((coder.counts[at] > 0).sum()), float(known[at].sum()), float(logs[i]),
                           len((part["text"][i].as_py() or "").encode()), None]
                    for column, value in zip(columns, own, strict=True):
                        column.append(value)
                    for column, value in zip(columns, [row, None, None, None, None, None, None, None, None], strict=True):
                        column.extend([value] * len(rare))
                    columns[3][len(columns[3]) - len(rare) :] = rare.values()
                    columns[8][len(columns[8]) - len(rare) :] = rare.keys()
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, word binary"
    scored = written(rows.mapInArrow(run, schema), "scores")
    rare = scored.filter("word is not null").select("row", "word", F.col("n_tokens").alias("n"))
    rare = rare.join(counts, "word").groupBy("row")
    rare = rare.agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    found = scored.filter("word is null").drop("word").join(rare, "row", "left")
    per_token = F.log10(F.lit(float(train_tokens + distinct + 1)))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _parts(batch: pa.RecordBatch, coder: Coder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The rows that are scored together, with the symbols of their texts."""
    for whole in slices(batch, "text", LOOKED_UP_CHARS, LOOKED_UP_ROWS):
        symbols, at = coder.symbols_of(whole.column("text")), 0
        for part in slices(whole, "text", SCORED_CHARS, SCORED_ROWS):
            yield part, symbols[at : at + len(part)]
            at += len(part)


def _letters(counts: DataFrame, frequent: dict[bytes, int]) -> np.ndarray:
    """How often each byte, and the terminator, is spelled in training."""
    least = min(frequent.values(), default=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            words = [w + b" " for w in batch.column("word").to_pylist()]
            weight = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), list(map(len, words)))
            total += np.bincount(np.frombuffer(b"".join(words), np.uint8), weight, minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total.astype(np.int64))], names=["letter", "n"])

    rest = counts.filter((F.col("c") < least) | (F.length("word") > LONGEST)).select("word", "c")
    sums = rest.mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    out = np.ones(256, np.int64)
    for row in sums:
        out[row["letter"]] += row["n"]
    return out
