"""Hashes of words that fool polynomial hashes, and very long words and texts, through the operators that use them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfolio.llm import jaccard, kernels, lm, toxicity
from samples import lowered, sentence, space_words


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


TWINS = [(thue_morse(n), thue_morse(n, "ba")) for n in (8, 64, 1024, 2048, 4096)]


def hashes(texts):
    raw, offsets = kernels.text_bytes(pa.array(texts))
    starts, ends, per_text = kernels.word_bounds(raw, offsets)
    return kernels.word_hashes(raw, starts, ends), per_text


def test_words_are_told_apart():
    words = [w for pair in TWINS for w in pair] + ["a" * n for n in range(1, 300)] + ["é", "e", "\U0001F600", "a\0", "a\0\0", "\0"]
    got, _ = hashes(words)
    assert len(set(got.tolist())) == len(words)
    again, _ = hashes([" ".join(w.upper() for w in words if w.isascii()), "x"])
    assert set(again.tolist()) - set(got.tolist()) == set(hashes(["x"])[0].tolist())
    assert np.array_equal(hashes(["A" * 500_000 + " b"])[0], hashes(["a" * 500_000, "b"])[0])


@pytest.mark.parametrize("twins", TWINS[2:])
def test_twins_are_no_near_duplicates(spark, twins):
    docs = spark.createDataFrame([(1, twins[0]), (2, twins[1]), (3, f"one {twins[0]} two three"), (4, f"one {twins[1]} two three")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_twins_are_words_of_their_own(spark):
    one, other = TWINS[2]
    rows = [(i, sentence(i, 30) + " " + one, False) for i in range(12)] + [(100, f"{other} brew0", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in lm.lm_scores(docs, F.col("held")).collect()}
    words = {w for i, t, held in rows if not held for w in space_words(t)}
    assert got[100].n_known == sum(w in words for w in space_words(f"{other} brew0")) + 1 == 2 if "brew0" in words else 1


def test_very_long_words_and_texts(spark):
    long_word, long_text = "Ab" * 600_000, sentence("megabyte", 180_000)
    rows = [(1, long_word), (2, long_word.lower()), (3, long_text), (4, long_text + " end"), (5, "short one"), (6, long_word[2:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long_text) > 1 << 20
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    labels = spark.createDataFrame([(5, 1), (3, 0)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels), ["doc_id"]).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    known = {r.doc_id: r.n_known for r in lm.lm_scores(docs, F.col("doc_id").isin(2, 6)).collect()}
    assert known[2] == 2 and known[6] == 1
    assert lowered(long_word) == long_word.lower()
