"""The mixing weights of op10 are learned on every training text, not on a sample of them."""

import numpy as np

from lakelog.llm import lm


def _setup(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = {bytes(r["word"]): r["c"] for r in lm.count_tokens(docs).collect()}
    listed = {w: c for w, c in counts.items() if w in (b"", b"the", b"of")}
    coder = lm.Coder(listed, sum(counts.values()), np.ones(256, np.int64))
    zeros, ones = lm.count_slots(docs, coder)
    return docs, coder, zeros, ones


def test_lm_weights_learned_on_all_training_texts(spark):
    texts = [f"the of odd{i % 7} the word{i % 13} of" * (1 + i % 3) for i in range(2_000)] + ["", None]
    docs, coder, zeros, ones = _setup(spark, texts)
    tokens = [[*lm.words_of(t or ""), b""] for t in texts]
    expected = np.full((lm._GATES, 3), 0.4)
    for at in range(0, len(tokens), lm.SCORED_ROWS):  # the slices scored together, each passed over twice
        facts = [lm._facts(run, coder.symbols(run), before, coder, zeros, ones) for run, before in lm._pieces(tokens[at : at + lm.SCORED_ROWS], coder)]
        for _ in range(lm.PASSES):
            for fact in facts:
                lm._update(expected, *fact)
    found = lm.learned_weights(docs, coder, zeros, ones)
    assert np.allclose(found, expected, rtol=1e-9, atol=1e-12)
    # the last texts take part: learned without them, the weights differ
    assert not np.allclose(lm.learn_weights(tokens[:400], coder, zeros, ones), found)


def test_lm_weights_of_tasks_are_averaged_by_bits(spark):
    texts = ["the of the odd", "of " * 90, "zebra the of odd", "the the of"]
    docs, coder, zeros, ones = _setup(spark, texts)
    parts = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    found = lm.learned_weights(parts, coder, zeros, ones)
    assert found.shape == (lm._GATES, 3) and np.isfinite(found).all()
