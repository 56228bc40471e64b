"""The training-data operators against brute force, exact round trips and planted cases."""

import collections
import hashlib
import html as references
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from lakelog.llm import alike, bpe, embeddings, html, language, lm, minhash, packing, pii, queries, simhash, warc
from lakelog.llm.components import components

FOLDER = "/root/testdata/sf0.001"
#: Null and empty texts, repeated rows, ties, a null id, a long text, columns with clashing names.
ODD = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "one two three four five six seven"),
    (5, "word " * 30_000),
    (6, "x" * 50_000),
    (7, "mail a.b@c.example or +1 (222) 555-0100 now <|endoftext|>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, key long")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# ------------------------------------------------------------------ SimHash


def _groups(prints, distance):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
                parent[find(b)] = find(a)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_are_those_of_brute_force(spark, seed):
    numbers = random.Random(seed)
    values = {numbers.getrandbits(64) - (1 << 63) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            flipped = v
            for bit in numbers.sample(range(63), numbers.randint(1, 4)):
                flipped ^= 1 << bit
            values.add(flipped)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {tuple(sorted(r)) for r in simhash.near_pairs(fps).distinct().collect()}
    assert found == {(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_thresholds_add_up_and_are_the_cheapest():
    numbers = np.random.default_rng(0)
    costs = [np.c_[np.zeros(50), numbers.random((50, 4)) * 9] for _ in range(3)]
    chosen = simhash.allocate(costs, 4)
    assert (chosen.sum(1) == 1).all()
    spent = sum(c[np.arange(50), t + 1] for c, t in zip(costs, chosen.T, strict=True))
    every = [(a, b, 4 - a - b) for a in range(5) for b in range(5 - a)]
    assert np.allclose(spent, np.min([sum(c[:, x] for c, x in zip(costs, e, strict=True)) for e in every], axis=0))


def test_simhash_query_agrees_with_brute_force(spark, texts):
    rows = queries.op1_simhash(spark, FOLDER).collect()
    prints = {i: simhash.simhash(simhash.shingle_hashes(t, 3, 42)) for i, t in texts.items()}
    group = _groups(set(prints.values()), 3)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, p in prints.items():
        least[group[p]] = min(least[group[p]], i)
    assert len(rows) == len(texts)
    assert all(r["fingerprint"] == f"{prints[r['doc_id']] & (1 << 64) - 1:016x}" for r in rows)
    assert all(r["component_id"] == least[group[prints[r["doc_id"]]]] for r in rows)


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("select xxhash64('a b c') h").first()["h"] == simhash.shingle_hashes("A b\tC", 3, 42).astype(np.int64)[0]


def test_simhash_of_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    assert sorted((r["doc_id"] or 0) for r in simhash.one_of_each(odd).collect()) == [1, 2, 5, 6, 7]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}


# ------------------------------------------------------------------ MinHash


def test_likeness_is_near_jaccard_and_shift_wraps(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_minhash(spark, FOLDER).collect()}
    order, off = sorted(texts, reverse=True), []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        new = minhash.edited(texts[i], texts[j])
        r = rows[i]
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == minhash.fingerprint(texts[i]) and r["edited_fingerprint"] == minhash.fingerprint(new)
        a, b = (set(simhash.shingle_hashes(t, 5, 0).tolist()) for t in (texts[i], new))
        if a and b:
            off.append(r["near_edited"] - len(a & b) / len(a | b))
    assert len(rows) == len(texts) and np.abs(off).max() < 0.15 and abs(np.mean(off)) < 0.01


def test_edits_of_odd_rows(odd):
    rows = minhash.fingerprint_edits(odd).collect()
    assert len(rows) == len(ODD) and {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 4)} == {""}
    assert minhash.fingerprint_edits(odd.limit(0)).count() == 0
    assert minhash.fingerprint_edits(odd.filter("doc_id = 7")).first()["near_next"] == 1.0


def test_empty_bins_are_filled():
    few = minhash.bins_of(np.array([5, 1 << 63], np.uint64))
    assert set(few.tolist()) == {5, 1 << 63} and len(few) == minhash.BINS


# ------------------------------------------------------------------ packing


def _total(plan):
    got = collections.Counter()
    for filling, copies in plan:
        for length, times in filling:
            got[length] += times * copies
    return dict(got)


@pytest.mark.parametrize("seed", range(20))
def test_plans_place_every_piece_and_respect_the_bound(seed):
    numbers = random.Random(seed)
    capacity = numbers.choice([10, 30, 100, 2048])
    counts = collections.Counter()
    for _ in range(numbers.randint(1, 40)):
        counts[numbers.randint(1, capacity)] += numbers.choice([1, 2, 5, 1000])
    first, best = packing.best_fit(counts, capacity), packing.complete(counts, capacity)
    for plan in (first, best):
        assert _total(plan) == dict(counts)
        assert all(sum(a * b for a, b in filling) <= capacity and copies > 0 for filling, copies in plan)
    used = [sum(copies for _, copies in plan) for plan in (first, best)]
    assert packing.lower_bound(counts, capacity) <= used[1] <= used[0]


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in bins of 10
    assert sum(n for _, n in packing.complete(counts, 10)) == 4


def test_packing_of_odd_rows_and_the_query(spark, odd, docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.TOKENIZER)
    for source, expected in ((odd, collections.Counter(i for i, _ in ODD)), (docs, collections.Counter(texts))):
        rows = packing.pack(source, queries.TOKENIZER).collect()
        assert {r["doc_id"] for r in rows} == set(expected)
        places = collections.defaultdict(list)
        for r in rows:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in places.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
            assert sum(n for _, n in parts) <= packing.CAPACITY
        whole = {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in (ODD if source is odd else texts.items())}
        for r in rows:
            ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert len(places) <= 1.02 * sum(map(len, whole.values())) / packing.CAPACITY + 1
    assert packing.pack(odd.limit(0), queries.TOKENIZER).count() == 0


def test_a_full_memory_still_encodes(texts):
    encoder = packing._Encoder(queries.TOKENIZER)
    encoder.memory.entries = 3
    some = list(texts.values())[:20]
    plain = [[*e.ids, 0] for e in encoder.model.encode_batch(some, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(some)] == plain


# ------------------------------------------------------------------ HTML

PAGE = (
    '<title>no</title><header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>'
    "<article><h1>A &amp; B</h1><p>First<br>para\n graph.<p>Second <b>bold</b> one.</p><script>var x='</p>';</script>"
    '<aside>Aside</aside></article><section class="comments"><p>Nice post.</p></section><form><label>Name</label></form><footer>End'
)


def test_articles_of_the_pages_are_extracted(spark):
    rows = {r["page_id"]: r for r in queries.op4_html(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        inside = page["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = [re.sub(r"\s+", " ", references.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        plain = "\n\n".join(b for b in blocks if b)
        assert rows[page["page_id"]]["text"] == plain and rows[page["page_id"]]["n_chars"] == len(plain)


def test_parts_other_than_the_article_go_and_odd_pages_work(spark):
    model = html.train(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", "<" * 5000), (4, "u", "<div>" * 9000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html.extract(pages, model).collect()
    assert [r["text"] for r in found if r["page_id"] == 1] == ["A & B\n\nFirst para graph.\n\nSecond bold one."] * 2
    assert len(found) == 6 and all(r["text"] == "" for r in found if r["page_id"] != 1)
    assert html.extract(pages.limit(0)).count() == 0


def test_gradients_are_those_of_finite_differences():
    model, features = html.Labeller(), html.Features()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    sequences = [[(("body", "p"), "some words"), (("nav",), "x")], [(("div", ".ad"), "y z")]]
    batch = html.prepare(features, sequences)
    labels, known = np.array([[1.0, 0], [0, 0]]), np.array([[True, True], [True, False]])

    def loss():
        z = model.scores(batch)
        return (np.where(known, np.logaddexp(0, z) - labels * z, 0)).sum() / 3

    exact = model.gradients(batch, labels, known)
    for name in ("xf", "hb", "cf", "out"):
        at = np.unravel_index(np.abs(exact[name]).argmax(), exact[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-4
        up = loss()
        model.p[name][at] = old - 1e-4
        slope = (up - loss()) / 2e-4
        model.p[name][at] = old
        assert abs(slope - exact[name][at]) < 1e-3 + 0.02 * abs(slope)


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.RANKS), special_tokens={})


def test_ids_are_tiktokens(spark, odd, texts, reference_encoding):
    codec = bpe.Codec(queries.RANKS, public_tokenizers.PATTERN)
    codec.by_piece.entries = 50
    numbers = random.Random(3)
    alphabet = ["a", " ", "\n", "\t", "é", "  ", "　", "\x1c", "1", "'s", "x!", "ab", "\x85", "\xa0", "😀", "<|endoftext|>"]
    made = ["".join(numbers.choice(alphabet) for _ in range(numbers.randint(0, 14))) for _ in range(2000)]
    for text in [*made, *list(texts.values())[:60], "ab" * 20_000]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    rows = bpe.encode_documents(odd, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == sorted((i or 0, len(reference_encoding.encode_ordinary(t or ""))) for i, t in ODD)
    assert bpe.encode_documents(odd.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ vectors


def test_links_of_planted_vectors(spark):
    numbers = np.random.default_rng(4)
    base = numbers.normal(size=(300, 32))
    near = base[:60] + 0.04 * numbers.normal(size=(60, 32)) * np.linalg.norm(base[:60], axis=1, keepdims=True) / 32**0.5
    vectors = np.concatenate([base, near, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [math.nan] * 32, 0), (903, [1.0, None], 0), (904, [], 0), (None, [1.0] * 32, 0), (905, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int")
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    exact = (unit @ unit.T >= 0.95).sum(1) - 1
    got = np.array([found[i]["n_links"] for i in range(len(vectors))])
    assert (got <= exact).all() and got.sum() >= 0.9 * exact.sum()
    assert found[300]["component_id"] == 0 and not found[300]["kept"] and found[0]["kept"]
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in (900, 901, 902, 903, 904, 905))
    assert len(found) == len(rows) and embeddings.near_duplicates(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ personal data


def _plain(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_plain_spans_are_those_of_the_patterns(texts):
    numbers = random.Random(2)
    made = ["".join(numbers.choice("a1.@- +(2_%)0\n") for _ in range(numbers.randint(0, 25))) for _ in range(20_000)]
    assert all(pii.detect(t) == _plain(t) for t in [*made, *texts.values()])


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write to bob (at) example (dot) com now", "email", "bob (at) example (dot) com"),
        ("x bob at example dot com", "email", "bob at example dot com"),
        ("to jоhn@exаmple.com!", "email", "jоhn@exаmple.com"),
        ("ring +one two three four five five five one two", "phone", "+one two three four five five five one two"),
        ("4​111 1111 1111 1111", "card", "4​111 1111 1111 1111"),
        ("see 192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises_are_mapped_back(text, kind, span):
    plain, more = pii.find_spans(text)
    assert plain == [] and [(text[s:e], pii.KINDS[k]) for s, k, e in more] == [(span, kind)]


def test_clean_texts_are_left_alone(spark, odd):
    assert pii.find_spans("meet me at the dot com crash, one of two or three") == ([], [])
    rows = {r["doc_id"]: r for r in pii.find_personal_data(odd).collect()}
    assert (rows[7]["n_email"], rows[7]["n_phone"], rows[2]["spans"]) == (1, 1, "")
    masked = {r["doc_id"]: r for r in pii.mask_personal_data(odd).collect()}
    assert masked[7]["text"] == "mail [EMAIL] or [PHONE] now <|endoftext|>" and masked[7]["n_chars"] == 41
    assert masked[2]["text"] is None and masked[7].asDict().keys() == set(odd.columns)


# ------------------------------------------------------------------ WARC


def test_archives_give_back_what_was_written(spark):
    long = "<p>" + "same " * 300
    rows = [(1, "http://a.example/x y", long), (9, "http://u:p@A.example:80/x y", long), (5, None, long), (2, "bad url", "short"), (3, "http://b.example", "short"), (4, "http://b.example#top", None), (None, "http://c.example", "é\r\n\r\nx"), (2, "bad url", "short")]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, offset int, key string")
    found = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect())
    expected = collections.Counter()
    for i, _, markup in rows:
        raw = (markup or "").encode()
        again = markup == long and i != 9
        expected[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None)] += 1
    assert found == expected
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_blocks_are_found_by_binary_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 2)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/", f"page {i}") for i in range(40)], "page_id long, url string, html string")
    captures = warc.write_archives(pages, f"{tmp_path}/r")
    index = warc.build_index(captures, f"{tmp_path}/i")
    wanted = pages.filter("page_id in (3, 17)").select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    asked = wanted.union(spark.createDataFrame([("com,nothing)/ 1",), (None,)], "key string"))
    assert sorted(r["page_id"] for r in warc.lookup(asked, index).collect()) == [3, 17]
    assert captures.filter("page_id = 3").first()["key"].startswith("example,h0)/ ")


def test_members_are_read_by_range_and_damage_is_seen():
    digest = hashlib.sha1(b"abc").hexdigest()
    member = warc.record(7, "http://x/\n", b"abc", digest, None)
    assert warc.parse(member)["payload"] == b"abc" and warc.parse(member)["url"] == "http://x/%0A"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(warc.record(7, "u", b"abd", digest, None))


# ------------------------------------------------------------------ language


def test_languages_are_those_of_the_labels(spark, docs):
    model = language.fit(docs)
    rows = language.identify(language.of_documents(docs).withColumn("declared", F.lit(None).cast("string")), model)
    right = rows.join(docs, "doc_id").select((F.col("language") == F.col("lang")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right >= 0.97
    assert language.accepted_only(docs).count() == docs.count()


def test_foreign_and_empty_texts_are_refused_and_evidence_counts(spark, docs):
    model = language.fit(docs)
    rows = [(1, "Это совсем другой язык и другие буквы", "en"), (2, None, "en"), (3, "12 34", "en"), (4, "the of and that with", None), (None, "the of and that", "en")]
    odd = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, language int")
    found = {r["doc_id"]: r for r in language.identify(language.of_documents(odd), model).collect()}
    assert [found[i]["accepted"] for i in (1, 2, 3, 4, None)] == [False, False, False, True, True]
    assert {r["doc_id"] for r in language.accepted_only(docs.unionByName(odd.drop("language").withColumn("n_chars", F.lit(0).cast("long")))).filter("doc_id is null or doc_id in (1)").collect()} >= {None}
    assert language.identify(language.of_documents(odd.limit(0)), model).count() == 0


def test_pages_bring_markup_suffix_and_host(spark):
    page = [(1, "https://www.shop.example.de/x", '<html lang="de-AT"><script>no</script>ja</html>'), (2, None, None)]
    row = language.of_pages(spark.createDataFrame(page, "page_id long, url string, html string")).orderBy("doc_id").collect()
    assert (row[0]["declared"], row[0]["suffix"], row[0]["host"], row[0]["parent"]) == ("de", "de", "www.shop.example.de", "example.de")
    assert row[0]["text"].strip() == "ja" and row[1]["host"] is None


# ------------------------------------------------------------------ language model


def test_scores(spark, odd, texts):
    rows = {r["doc_id"]: r for r in queries.op10_lm(spark, FOLDER).collect()}
    tokens = {i: [*lm.words_of(t), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(ws), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    found = lm.score_documents(odd).collect()
    assert len(found) == len(ODD) and {r["n_tokens"] for r in found if r["doc_id"] in (2, 3, 4)} == {1}
    assert lm.score_documents(odd.limit(0)).count() == 0


def test_code_words_sum_to_one_and_scores_do_not_depend_on_neighbours():
    code = lm.Code(np.array([5, 1, 1, 9, 2, 2]))
    assert sum(2.0 ** -int(n) for n in code.lengths) == 1
    coder = lm.Coder({b"": 9, b"the": 7, b"of": 3}, 30, np.ones(256, np.int64))
    odds, weights = np.random.default_rng(1).normal(size=3 << lm.SLOT_BITS).astype(np.float32), np.full((lm._GATES, 3), 0.3)
    many = [[*lm.words_of(t), b""] for t in ("the of the odd", "of " * 90, "", "zebra the of")]
    together = lm.score_texts(many, [coder.symbols(t) for t in many], coder, odds, weights)
    alone = [lm.score_texts([t], [coder.symbols(t)], coder, odds, weights)[0] for t in many]
    assert np.allclose(together, alone, rtol=1e-5)


# ------------------------------------------------------------------ queries and pipeline


def test_every_operator_has_a_query():
    names = driver.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    rows = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(result.fetchall(), key=repr)


def test_pipeline_stages(spark, docs):
    extra = [(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "the and of that with to be one two three x@y.example", "en", "s", 0)]
    source = docs.union(spark.createDataFrame(extra, docs.schema))
    kept = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 10_001 not in rows and 10_002 not in rows and rows[10_003].endswith("[EMAIL]")
    assert not any(pii.detect(t) for t in rows.values())
    whole = {i: t for i, t in ((r["doc_id"], r["text"]) for r in source.collect()) if t and re.search(r"[^\W\d_]", t)}
    prints = {i: simhash.simhash(simhash.shingle_hashes(t, 3, 42)) for i, t in whole.items()}
    group, least = _groups(set(prints.values()), 3), {}
    for i, p in prints.items():
        least[group[p]] = min(least.get(group[p], i), i)
    assert set(rows) == set(least.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_pipeline_dedup_stage_is_simhash(spark, docs):
    _, stage = corpus_pipeline.STAGES[1]
    kept = {(r["doc_id"], r["text"]) for r in stage(spark, docs, FOLDER).collect()}
    assert kept == {(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()}
