"""Token files, ranked search and spelling variants against brute force, round trips and odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lakelog.llm import lexical, queries, spelling, token_files

FOLDER = "/root/testdata/sf0.001"
#: Null and empty texts, repeated rows, ties, null ids, a long text, and columns with clashing names.
ODD = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),
    (1, "another text of the same id"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "one two three four five six seven"),
    (None, None),
    (5, "wörter word " * 30_000),
    (6, "x" * 50_000),
    (7, "Ünïcode ÀÉ café <|endoftext|> 12 don't　中文"),
]
CLASHING = "doc_id long, text string, term string, shard long, q long, word string, n long, path string, start long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1, 2, "w", 3, "p", 4) for i, t in ODD], CLASHING)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# ------------------------------------------------------------------ token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.WORDS)
    return lambda text: np.array(model.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_gives_what_the_library_gives(library):
    numbers = random.Random(1)
    letters = list(" \n\tabcXYZ'sdv019.,!ñÉßİΣσς́ẛ̣　\x1c\x85<|endoftext>中文🙂ſK²½ªµ˂\x00\x7fЖж\xad")
    texts = ["".join(numbers.choice(letters) for _ in range(numbers.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x400, 32)]
    texts += [" ".join(map(chr, range(a, a + 64))) for a in range(0, 0x400, 32)]
    texts += ["<|endoftext|> a", "x<|startoftext|>y", "<|EndOfText|>", "don't'Ve"]
    encoder = token_files.Encoder(queries.WORDS)
    assert encoder.width == 2
    for text in texts + texts[:50]:
        assert np.array_equal(np.frombuffer(encoder.encode(text), "<u2"), library(text)), repr(text)


def test_other_vocabularies_are_encoded_by_the_library():
    from tokenizers import Tokenizer

    path, text = public_tokenizers.path("byte_bpe_50k.json"), "Hello  world,\nagain and again 中文"
    encoder = token_files.Encoder(path)
    assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == Tokenizer.from_file(path).encode(text).ids


def expected_files(rows, library, order):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=order):
        ids = np.append(library(text), queries.END_ID).astype("<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_the_documents(spark, docs, library):
    found = queries.QUERIES["op11_token_files"](spark, FOLDER)
    assert dict(found.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, found.collect())) == expected_files(rows_of(docs), library, lambda r: r[0])


def test_files_of_odd_rows(spark, odd, library, tmp_path):
    got = token_files.write_and_read(odd, queries.WORDS, str(tmp_path), queries.END_ID).collect()
    start = 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    want = [(i, n, c) for i, _, n, c in expected_files(rows_of(odd), library, lambda r: (r[0] is not None, r[0] or 0))]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter(want)


def test_no_documents_make_no_files(spark, odd, tmp_path):
    none = odd.limit(0)
    assert token_files.train(none, queries.WORDS, 1) == b""
    assert token_files.write_files(none, queries.WORDS, str(tmp_path), 1, b"").count() == 0
    assert token_files.write_and_read(none, queries.WORDS, str(tmp_path), 1).collect() == []


def test_one_document_is_read_by_ranges(spark, docs, library, tmp_path):
    dictionary = token_files.train(docs, queries.WORDS, 1)
    files = token_files.write_files(docs, queries.WORDS, str(tmp_path), 1, dictionary).orderBy("part", "file").collect()
    texts = dict(rows_of(docs))
    assert sum(f["documents"] for f in files) == len(texts)
    opened = [token_files.TokenFile(f["path"], dictionary) for f in files]
    ids = [i for file in opened for i in file.doc_ids(0, file.documents)]
    assert ids == sorted(texts)  # files and the documents in them ascend
    for doc_id in random.Random(2).sample(ids, 20):
        found = [x for file in opened for x in file.find(doc_id)]
        assert len(found) == 1 and found[0].tolist() == [*library(texts[doc_id]).tolist(), 1]
    assert [x for file in opened for x in file.find(-5)] == []
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(files[0]["path"], dictionary + b"x")
    assert (tmp_path / f"{hashlib.sha256(dictionary).hexdigest()}.dict").read_bytes() == dictionary


def test_the_dictionary_makes_short_documents_smaller(docs):
    import zstandard

    encoder = token_files.Encoder(queries.WORDS)
    short = [encoder.encode(t) for _, t in rows_of(docs) if t and len(t) < 2000]
    shared = zstandard.ZstdCompressionDict(token_files.make_dictionary(short))
    plain, dictionary = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=shared)
    assert sum(len(dictionary.compress(s)) for s in short) < 0.8 * sum(len(plain.compress(s)) for s in short)
    assert token_files.make_dictionary([]) == b"" and token_files.make_dictionary([b"abc", b""]) == b"abc"


def test_starts_run_over_blocks_of_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILES_BLOCK", 2)
    rows = [(p, f, f"{p}-{f}", 1, 10 * p + f + 1, 1) for p in range(7) for f in range(3)]
    got = {r["path"]: r["start"] for r in token_files.with_starts(spark.createDataFrame(rows, token_files.FILES)).collect()}
    start = 0
    for _, _, path, _, tokens, _ in rows:
        assert got[path] == start
        start += tokens


# ------------------------------------------------------------------ search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_search(rows, items, top=50):
    """``{item: [(doc place, score)]}`` by the formula, one document after the other."""
    held = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * N) // L
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if t in c:
                    w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0))
        for rank, (less, known, doc_id) in enumerate(sorted(scores)[:top], 1):
            out.append((item_id, rank, doc_id if known else None, -less))
    return sorted(out, key=repr)


def test_terms_are_cut_alike_in_any_chunk(monkeypatch):
    text = "Ab1 cÄd__EéF \x7f中文x" * 50
    want = TERM.findall(text.translate(LOWER))
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(lexical, "CHUNK", chunk)
        assert [t.decode() for some in lexical.terms_of(text.encode()) for t in some] == want


@pytest.mark.parametrize("seed", range(12))
def test_a_shard_answers_like_brute_force(seed, monkeypatch):
    numbers = random.Random(seed)
    monkeypatch.setattr(lexical, "BLOCK", numbers.choice([4, 16, 128]))
    monkeypatch.setattr(lexical, "FIRST_WINDOW", numbers.choice([8, 64]))
    monkeypatch.setattr(lexical, "LAST_WINDOW", numbers.choice([64, 512]))
    many = numbers.choice([20, 300, 3000])
    word = lambda: f"w{min(int(numbers.paretovariate(0.5)), many)}"
    rows = [(i, " ".join(word() for _ in range(numbers.choice([1, 5, 50, 400])))) for i in range(numbers.choice([1, 30, 500]))]
    items = [(q, " ".join(word() for _ in range(numbers.choice([1, 3, 30])))) for q in range(10)]
    shard = lexical._Shard()
    for i, text in rows:
        shard.add(i, text.encode())
    read = list(lexical._columns(pa.Table.from_batches([shard.rows(0)])))
    head = np.frombuffer(read[-1]["body"], "<i8")
    count = len(head) // 2
    corpus = lexical.Corpus(count, int(head[1 + count :].sum()))
    norms = corpus.norm(head[1 + count :])
    lists = {r["term"]: lexical.Postings(r, corpus.weight(r["df"]), corpus, norms) for r in read if r["term"]}
    got = []
    for q, text in items:
        docs, scores = lexical.search_shard([lists[t] for t in set(text.split()) if t in lists], count, 10)
        got += [(q, rank, d, s) for rank, (d, s) in enumerate(zip(docs.tolist(), scores.tolist()), 1)]
    assert sorted(got, key=repr) == brute_search(rows, items, 10)


def test_blocks_are_rejected_before_they_are_unpacked():
    """One strong rare term and a common weak one: most blocks of the common one stay packed."""
    shard = lexical._Shard()
    for i in range(8000):
        shard.add(i, b"common " * (1 + i % 3) + (b"rare " * 5 if i % 400 == 7 else b"") + b"filler " * (i % 50))
    read = list(lexical._columns(pa.Table.from_batches([shard.rows(0)])))
    head = np.frombuffer(read[-1]["body"], "<i8")
    corpus = lexical.Corpus(8000, int(head[8001:].sum()))
    lists = [lexical.Postings(r, corpus.weight(r["df"]) or 1, corpus, corpus.norm(head[8001:])) for r in read if r["term"] in ("common", "rare")]
    lexical.search_shard(lists, 8000, 10)
    common = next(x for x in lists if len(x.last) > 50)
    assert len(common.kept) < len(common.last) / 2


def test_search_of_odd_rows_in_several_passes(spark, odd, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    items = [(1, "seven six word"), (1, "seven six word"), (2, None), (3, ""), (4, "nowhere"), (None, "CAFÉ café wörter"), (5, "one"), (6, "12 text x")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, q long, rank long")
    got = lexical.search(lexical.build_index(odd), frame).collect()
    want = brute_search(rows_of(odd), list(dict.fromkeys(items)))
    assert sorted(map(tuple, got), key=repr) == want and {r["item_id"] for r in got} == {1, None, 5, 6}


def test_search_of_nothing(spark, odd):
    frame = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.build_index(odd.limit(0)), frame).collect() == []
    assert lexical.search(lexical.build_index(odd), frame.limit(0)).collect() == []


# ------------------------------------------------------------------ spelling


def brute_words(rows, every=31):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    """Every pair of words that share a text with one letter taken out, checked letter by letter."""
    bins = collections.defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) < 100 else {w}:
            bins[key].add(w)
    near = collections.defaultdict(set)
    for some in bins.values():
        for a in some:
            near[a].update(b for b in some if b != a and one_edit(a, b))
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def checked(found, counts):
    got = {r["word"]: (r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}
    assert got == brute_variants(counts)
    return got


def test_variants_of_the_documents(spark, docs):
    found = queries.QUERIES["op13_spelling"](spark, FOLDER)
    kinds = {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert dict(found.dtypes) == kinds
    assert len(checked(found, brute_words(rows_of(docs)))) > 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_over_many_cells(spark, seed):
    """Few letters, so that words lie close and most searches cross borders; counts with many ties."""
    numbers = random.Random(seed)
    counts = {}
    for _ in range(900):
        w = "".join(numbers.choice("abcé") for _ in range(numbers.choice([7, 8, 9, 10])))
        counts[w] = numbers.choice([2, 3, 20, 30, 30, 300, 4000])
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    checked(spelling.variants(frame, cell=20, sample=300), counts)


def test_chains_end_in_their_root(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghik": 2000, "zzzzzzz": 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = checked(spelling.variants(frame), counts)
    assert got["abcdefg"][2] == "abcdefghij" and got["abcdefghi"][1] == "abcdefghij" and got["zzzzzzz"][4] == 0


@pytest.mark.parametrize("seed", range(6))
def test_a_cell_finds_all_pairs_once(seed, monkeypatch):
    numbers = random.Random(seed)
    monkeypatch.setattr(spelling, "LEAF", numbers.choice([1, 4, 32]))
    monkeypatch.setattr(spelling, "COMPARED", numbers.choice([50, 1 << 21]))
    letters = numbers.choice([b"ab", b"abc\xe9\xf1", b"abcdefghij"])
    some = sorted({bytes(numbers.choice(letters) for _ in range(numbers.choice([7, 8, 9]))) for _ in range(500)})
    for length, step in ((7, 0), (8, 1), (8, -1), (8, 0), (9, 1)):
        members, asking = [w for w in some if len(w) == length], [w for w in some if len(w) == length - step]
        got = []
        for a, b in spelling.near_in_cell(spelling.letters_of(members, length), spelling.letters_of(asking, length - step), step >= 0, step <= 0):
            got += zip(a.tolist(), b.tolist())
        want = {(i, j) for i, a in enumerate(asking) for j, b in enumerate(members) if one_edit(a, b)}
        assert len(got) == len(set(got)) and set(got) == want


def test_runs_are_cut_alike_in_any_chunk(monkeypatch):
    text = "Straße ×÷Ünï 中文Wort_wörter123xĀY" * 40
    want = [r.translate(LOWER) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    for chunk in (1, 5, 1 << 20):
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        assert [r.decode("latin-1") for some in spelling.runs_of(text) for r in some] == want


def test_variants_of_odd_rows(spark, odd):
    texts = ["Spelling spelling SPELLING", "spellings spelling", "spelxing spelxing", None, "", "ÀÉÎÕÜßñ ÀÉÎÕÜßñ àéîõüßñ"]
    extra = [(i if i != 3 else None, t, "a", 1, 2, "w", 3, "p", 4) for i, t in enumerate(texts * 4)]
    rows = odd.union(spark.createDataFrame(extra, CLASHING))
    counts = brute_words(rows_of(rows))
    assert "x" * 50_000 not in counts and "ÀÉÎÕÜßñ" in counts
    checked(spelling.spelling_variants(rows), counts)
    twice = odd.union(odd)
    assert "x" * 50_000 in {r["word"] for r in checked(spelling.spelling_variants(twice), brute_words(rows_of(twice))).values() for r in [{"word": r[0]}]}
    assert spelling.spelling_variants(odd.limit(0)).collect() == []
