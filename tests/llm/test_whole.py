"""Cases that an operator answered from a part of its input before."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lakelog.llm import alike, html, language, lm, pii

FOLDER = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ near-duplicates of the pipeline


def _least_of_groups(texts):
    sets = {i: set(alike.shingle_set(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (not union or len(sets[a] & sets[b]) / union >= 0.8):
                first, second = sorted((find(a), find(b)))
                parent[second] = first
    return {find(i) for i in sets}


@pytest.mark.parametrize("stars, block", [(alike.STARS, alike.BLOCK), (0, 3)])
def test_the_stage_keeps_one_of_each_group_at_jaccard_0_8(spark, monkeypatch, stars, block):
    """With the usual rounds, and with all pairs left to the blocks of the last one."""
    monkeypatch.setattr(alike, "STARS", stars)
    monkeypatch.setattr(alike, "BLOCK", block)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    numbers = np.random.default_rng(6)
    made, schema = [], docs.schema
    for base in range(12):
        words = [f"w{x}" for x in numbers.integers(0, 3000, 300)]
        for copy in range(6):  # a changed word touches five shingles
            edited = list(words)
            for at in numbers.choice(300, int(numbers.integers(0, 9)), replace=False):
                edited[at] = f"e{numbers.integers(0, 1 << 30)}"
            made.append((20_000 + 10 * base + copy, " ".join(edited), "en", "s", 0))
    source = docs.union(spark.createDataFrame(made, schema))
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    found = [r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, source, FOLDER).collect()]
    assert sorted(found) == sorted(_least_of_groups(texts))


def test_one_of_each_keeps_columns_whose_names_clash(spark):
    columns = "doc_id long, text string, _text string, node long, key string, n long, component string, hashes string"
    rows = [(i, t, "kept", 1, "k", 2, "c", "h") for i, t in [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (4, "")]]
    found = alike.one_of_each(spark.createDataFrame(rows, columns))
    assert found.columns == [c.split()[0] for c in columns.split(", ")]
    assert sorted(map(tuple, found.collect())) == sorted({r for r in rows if r[0] in (1, 2)})


def test_the_last_round_counts_a_pair_once(spark):
    """Sets that share several bands are compared under the first of them."""
    numbers, sets = np.random.default_rng(3), {}
    base = np.unique(numbers.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    for node in range(30):
        sets[node] = np.unique(np.r_[base[: 300 + 3 * node], numbers.integers(0, 1 << 63, 20, dtype=np.uint64)])
    bins = {i: alike.bins_of(s, alike._BINS) for i, s in sets.items()}
    rows = [
        (i, len(s), alike._keys(bins[i]), bytearray(bins[i].astype(np.uint8).tobytes()), i % 25, band, key)
        for i, s in sets.items()
        for band, key in enumerate(alike._keys(bins[i]))
    ]
    frame = spark.createDataFrame(rows, "node long, n long, keys array<long>, bins binary, component long, band int, key long")
    found = [tuple(sorted(r)) for r in alike._met_in_blocks(frame, 0.8).collect()]
    assert len(found) == len(set(found))
    close = {(a, b) for a in sets for b in sets if a < b and a % 25 != b % 25 and alike._jaccard(sets[a], sets[b]) >= 0.8}
    met = {(a, b) for a, b in close if set(alike._keys(bins[a])) & set(alike._keys(bins[b]))}
    assert met <= set(found) and len(met) > 0.99 * len(close)


def test_bands_meet_at_the_threshold():
    numbers = np.random.default_rng(8)
    for shared in (8, 40, 400):  # of 10, 50, 500: similarity 0.8
        met = 0
        for _ in range(300):
            hashes = numbers.integers(0, 1 << 63, shared * 5 // 4, dtype=np.uint64) * np.uint64(2)
            half = (len(hashes) - shared) // 2
            a, b = hashes[: shared + half], np.r_[hashes[:shared], hashes[shared + half :]]
            met += any(x == y for x, y in zip(alike.band_keys(np.unique(a)), alike.band_keys(np.unique(b)), strict=True))
        assert met >= 298


# ------------------------------------------------------------------ personal data


@pytest.mark.parametrize(
    "text, kind",
    [
        ("bob (at) example dot com", "email"),
        ("bob@example dot com", "email"),
        ("bob at example.com", "email"),
        ("bob at example (dot) com", "email"),
        ("bob dot j.smith [at] mail dot example.com", "email"),
        ("a dot b dot c dot d dot e dot f dot g at h dot i dot j dot k dot l dot m dot com", "email"),
        ("bob at dot dot com", "email"),
        ("192 dot 168 dot 1 dot 1", "ip"),
        ("192 dot 168.1 [dot] 1", "ip"),
    ],
)
def test_mixed_disguises_are_found(text, kind):
    plain, more = pii.find_spans(f"x: {text}, y")
    assert plain == [] and [(s, e, pii.KINDS[k]) for s, k, e in more] == [(3, 3 + len(text), kind)]
    assert pii.masked(f"x: {text}, y", more) == f"x: [{kind.upper()}], y"


def test_prose_and_long_chains_stay_quick():
    for text in ("We met at noon. Then at home dot", "look at the dot by the dot", "1 dot 2 dot 3", "at the dot com"):
        assert pii.find_spans(text) == ([], [])
    for text in ("a dot " * 200_000, "a at " * 200_000, "a@" * 200_000, "a at b dot " * 100_000, "1 dot " * 200_000):
        pii.find_spans(text)


# ------------------------------------------------------------------ web pages


def test_features_read_whole_blocks_and_all_names():
    features, opening = html.Features(), "word " * 24
    prose, advert = features.text(opening + "and so it goes on."), features.text(opening + "buy now! " * 40)
    assert prose[:8] != advert[:8] and prose[9] != advert[9] and prose[10] != advert[10]
    many = " ".join(chr(97 + i) * 3 for i in range(20))
    ((names, _),) = html.leaves(f'<div class="{many} advert"><p>Text</p></div>')
    assert ".advert" in names and html.teacher((names, "Text")) is False
    assert len(features.path(names)) == len(names) + 1
    long = "one two. " * 20_000
    assert np.allclose(features.text(long.strip())[8:], [np.log1p(len(long) - 1) / 4, np.log1p(40_000) / 2, 0.5])


def _long_page(i):
    """A page of over 60,000 characters and its article."""
    links = "".join(f'<div class="zq">Link {i} {k}</div>' for k in range(1500))
    prose = "".join(f"<p>Sentence {k} of the long page {i} goes on for some words.</p>" for k in range(1200))
    return f"<body><nav>{links}</nav><article>{prose}</article></body>", prose


def test_a_table_of_long_pages_trains_the_labeller(spark):
    made = [_long_page(i) for i in range(8)]
    assert all(len(markup) > 60_000 for markup, _ in made)
    pages = spark.createDataFrame([(i, "u", markup) for i, (markup, _) in enumerate(made)], "page_id long, url string, html string")
    for row in html.extract(pages).collect():
        prose = made[row["page_id"]][1]
        assert row["text"] == "\n\n".join(prose[3:-4].split("</p><p>"))


def test_without_a_page_to_learn_from_made_sequences_train_the_labeller(spark):
    model, none = html.train(spark.createDataFrame([], "page_id long, html string")), html.Labeller()
    assert not np.array_equal(model.p["out"], none.p["out"])
    page = html.leaves("<nav><ul><li><a>Home</a></ul></nav><article><h1>News</h1><p>The bridge opens on Monday, they said.</p></article><footer>Contact</footer>")
    assert model.label(html.Features(), [page]) == [[False, True, True, False]]


def test_only_raw_text_elements_are_skipped_and_values_have_any_length():
    def texts(markup):
        return " | ".join(text for _, text in html.leaves(markup))

    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>") == "Let x=2 here"
    assert texts("<p>one</p><svg/><p>two</p><object data=x /><p>three</p>") == "one | two | three"
    assert texts("<p>one</p><template><p>two</p>") == "one | two"
    assert texts("<svg><p>one</p>") == "one" and texts("<object><p>fallback</p></object>") == "fallback"
    assert texts(f'<p data-x="{"a > b " * 2000}">one</p>') == "one" and texts(f"<p data-x='{'>' * 9000}'>one</p>") == "one"
    assert texts('<p title=">">one</p><a "x>two</a> <b class="y">three</b>') == "one | two three"
    assert texts("<script>if (a > b) x()</script><style>p > a {}</style><title>t</title><p>one</p>") == "one"


def test_a_stray_less_than_sign_is_text():
    page = "<article><p>We know that a < b holds and c <= d.</p><p>If x <3 then y.</p></article><p>tail < of"
    assert [text for _, text in html.leaves(page)] == ["We know that a < b holds and c <= d.", "If x <3 then y.", "tail < of"]
    assert [text for _, text in html.leaves("<p>kept</p><p>cut <a href='x")] == ["kept", "cut"]


@pytest.mark.parametrize("levels", [1, 14, 30, 90])
def test_rules_see_all_elements_above_a_leaf(levels):
    inside = "<div class='row'>" * levels + "<p>Text.</p>" + "</div>" * levels
    for tag, label in (("article", True), ("nav", False), ("section", None)):
        (leaf,) = html.leaves(f"<{tag}>{inside}</{tag}>")
        assert html.teacher(leaf) is label
    listed = html.leaves("<ul><li>" + "<b>" * levels + "one<li>two</ul>")
    assert [names for names, _ in listed][1] == ("ul", "li")


# ------------------------------------------------------------------ language: the fusion, and labels of any number


def _shares(rows, size, towards):
    """Sums of the rows' beliefs, drawn towards other shares."""
    return (sum(rows, np.zeros(size)) + language.STRENGTH * towards) / (sum(map(sum, rows)) + language.STRENGTH)


def _fused(rows, table):
    """Posterior of each row, one after the other: ``(text, declared, suffix, host, parent)`` to shares and best place."""
    size = table.shape[1]
    grams = [[g for w in text.lower().split() for g in language._trigrams(w)] for text, *_ in rows]
    likelihood = [sum((table[g] for g in gs), np.zeros(size)) * language.TEMPER for gs in grams]
    belief = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() if gs else None for x, gs in zip(likelihood, grams, strict=True)]
    judged = [(row, b) for row, b in zip(rows, belief, strict=True) if b is not None]
    share = (sum((b for _, b in judged), np.zeros(size)) + 1) / (len(judged) + size)
    share = np.r_[share[:-1] * (1 - language.OTHER_PRIOR) / share[:-1].sum(), language.OTHER_PRIOR]
    out = []
    for (_, declared, suffix, host, parent), x in zip(rows, likelihood, strict=True):
        score = x + np.log(share)
        known_host = [b for r, b in judged if host is not None and r[3] == host]
        if known_host:
            above = _shares([b for r, b in judged if r[4] == parent], size, share)
            score = x + np.log(np.r_[_shares(known_host, size, above)[:-1], language.OTHER_PRIOR])
        for place, value in ((1, declared), (2, suffix)):
            same = [b for r, b in judged if value is not None and r[place] == value]
            if same:
                score[:-1] += np.log(_shares(same, size, share)[:-1] / share[:-1])
        out.append((np.exp(score - score.max()) / np.exp(score - score.max()).sum()).max())
    return out


def test_fusion_is_that_of_plain_python(spark):
    texts = {"en": "the of and that with this", "de": "der und das nicht mit ist", "fr": "le la et que dans pour"}
    taught = [(i, t, lang, None, None, None, None) for i, (lang, t) in enumerate(texts.items())]
    kinds = "doc_id long, text string, lang string, declared string, suffix string, host string, parent string"
    languages, table = language.fit(spark.createDataFrame(taught, kinds))
    assert languages == ["de", "en", "fr"]
    random = np.random.default_rng(3)
    words = [w for t in texts.values() for w in t.split()] + ["xyzzy", "42", "qua"]
    rows = []
    for _ in range(60):
        host, parent = [("a.x.de", "x.de"), ("b.x.de", "x.de"), ("y.fr", "y.fr"), ("z", None), (None, None)][random.integers(5)]
        text = " ".join(random.choice(words, random.integers(0, 4)))
        rows.append((text, [None, "de", "en", "tlh"][random.integers(4)], [None, "de", "fr"][random.integers(3)], host, parent))
    rows += rows[:5]
    docs = spark.createDataFrame([(i, t, None, *rest) for i, (t, *rest) in enumerate(rows)], kinds).drop("lang")
    found = {r["doc_id"]: r for r in language.identify(docs, (languages, table)).collect()}
    assert len(found) == len(rows)
    for i, (row, expected) in enumerate(zip(rows, _fused(rows, table), strict=True)):
        letters = any(c.isalpha() for c in row[0])
        assert found[i]["probability"] == pytest.approx(expected if letters else 0.0, rel=1e-6), row


def test_every_label_is_a_language_of_the_model(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 3, f"l{i:02}") for i in range(80)]
    rows += [(1000 + i, "the of and that with", "en") for i in range(300)] + [(2000, None, "en"), (2001, "x", None), (2002, "y", "")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, table = language.fit(labelled, sample=20)
    assert languages == sorted(["en", *(f"l{i:02}" for i in range(80))]) and table.shape[1] == 82
    few = language._trigrams("wordba")  # of the label that has a single row
    assert all(table[g, languages.index("l01")] > table[g, languages.index("en")] for g in few[-2:])
    assert language.fit(labelled.filter("lang is null"))[0] == []


def test_sample_texts_are_learned_from_whole(monkeypatch):
    coder = lm.Coder({b"": 9, b"the": 7, b"of": 3}, 30, np.ones(256, np.int64))
    monkeypatch.setattr(lm, "ROUND", 4)
    tokens = [*lm.words_of("the of the odd of the the of of"), b""]
    pieces = list(lm._pieces([tokens, [b""]], coder))
    assert [t for run, _ in pieces[:-1] for t in run] == tokens
    symbols = coder.symbols(tokens)
    assert [b.tolist() for _, b in pieces] == [[[0, 0]], [[symbols[3], symbols[2]]], [[symbols[7], symbols[6]]], [[0, 0]]]


def test_lm_words_of_a_column_are_those_of_each_text():
    texts = ["".join(map(chr, range(128))), "", None, " \t a\x0bB  ", "É A\x1cb\x85c d ", "x", "the of the"]
    column = pa.array(["cut off", *texts]).slice(1)
    words, lengths = lm.split_words(column)
    assert words.to_pylist() == [w for t in texts for w in lm.words_of(t or "")]
    assert lengths.tolist() == [len(lm.words_of(t or "")) for t in texts]
    coder = lm.Coder({b"": 9, b"the": 7, b"of": 3}, 30, np.ones(256, np.int64))
    expected = [coder.symbols([*lm.words_of(t or ""), b""]).tolist() for t in texts]
    assert [s.tolist() for s in coder.symbols_of(column)] == expected
    many = pa.array([f"The {i} of\tB" for i in range(3000)])
    for start, n in ((0, 10), (1280, 1234), (2990, 10)):
        words, lengths = lm.split_words(many.slice(start, n))
        assert words.to_pylist() == [w for i in range(start, start + n) for w in (b"the", b"%d" % i, b"of", b"b")]
        assert lengths.tolist() == [4] * n


def test_lm_slots_hold_every_bit_of_the_training_texts(spark):
    texts = ["the of the odd", "of " * 90, "", None, "zebra the of odd"]
    tokens = [[*lm.words_of(t or ""), b""] for t in texts]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = {bytes(r["word"]): r["c"] for r in lm.count_tokens(docs).collect()}
    assert counts == Counter(w for ws in tokens for w in ws)
    listed = {w: c for w, c in counts.items() if w in (b"", b"the", b"of")}
    coder = lm.Coder(listed, sum(counts.values()), np.ones(256, np.int64))
    zeros, ones = lm.count_slots(docs, coder)
    expected = np.zeros((2, len(zeros)), np.int64)
    for ws in tokens:
        _, slots, bit = coder.bits(coder.symbols(ws), ws.__getitem__, np.zeros(len(ws), np.int64), np.zeros((1, 2), np.int64))
        for row in slots:
            np.add.at(expected, (bit, row), 1)
    assert (zeros == expected[0]).all() and (ones == expected[1]).all()
