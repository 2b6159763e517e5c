"""Scores, languages, tokens, near duplicates and toxicity against plain versions, round trips and held-out rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfolio.llm import catalog, jaccard, kernels, language, lm, lm_model, repair, token_files, toxicity
from wayfolio.llm.common import KEY_RANGE, random_key, remainder, table
from samples import messy, messy_rows, nothing, sentence, space_words  # noqa: F401

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_components(rows, size, percent):
    sets = []
    for _, text in rows:
        words = space_words(text)
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    return sorted(
        (repr(d), len(sets[i]), repr(min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def near_rows():
    base = sentence("near", 150).split()
    rows = [(i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1:] if i % 3 else base[:2 * i] + base[2 * i + i % 5:])) for i in range(60)]
    rows += [(100 + i, " ".join(base[i:] + sentence(f"tail{i}", i).split())) for i in range(1, 40)]
    chain = sentence("chain", 60).split()
    return rows + [(200 + i, " ".join(chain[i:i + 40])) for i in range(20)] + [(300, " ".join(base)), (301, "one two"), (302, "one  TWO"), (303, "one")]


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(spark, size, percent):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("mark", F.lit("x")).repartition(6)
    got = jaccard.jaccard_components(docs, size, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == plain_components(rows, size, percent)


def test_jaccard_messy(messy, nothing):
    rows = [(d, t) for d, t, *_ in messy_rows()]
    got = jaccard.jaccard_components(messy).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == plain_components(rows, 3, 90)
    kept = jaccard.one_of_each(messy)
    assert kept.dtypes == messy.dtypes
    alone = [t for _, t in rows if not space_words(t)]
    groups = {c for _, n, c in plain_components(rows, 5, 80) if n}
    assert kept.count() == len(alone) + len(groups)
    assert jaccard.jaccard_components(nothing).count() == 0


def test_kernels_split_and_hash_words():
    texts = ["A b\tC", None, "", "x" * 700_000 + " é", "a b c", " a  b\nc\x0b", "É"]
    raw, offsets = kernels.text_bytes(pa.array(texts).slice(0))
    starts, ends, per_text = kernels.word_bounds(raw, offsets)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    hashes = kernels.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len({w.lower() if w.isascii() else w for w in found})
    sliced, at = kernels.text_bytes(pa.array(texts).slice(4, 2))
    s, e, _ = kernels.word_bounds(sliced, at)
    assert kernels.word_hashes(sliced, s, e)[:3].tolist() == hashes[:3].tolist()


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 40_000, rng.integers(1, 6)) for _ in range(200)]
    for n in (0, 1, 2, 3000):
        parts = [np.append(np.concatenate([words[i] for i in rng.zipf(1.4, n) % 200]), repair.SEPARATOR) for _ in range(5)] if n else [[repair.SEPARATOR]]
        ids = np.concatenate([*parts, [7] * 50, [repair.SEPARATOR]]).astype(np.uint32)
        grammar = repair.compress(ids)
        assert (grammar.expand(grammar.symbols) == ids).all() and grammar.sizes(grammar.symbols).sum() == len(ids)
        assert (grammar.rules != repair.SEPARATOR).all()
        for first in (0, len(ids) // 3, len(ids) - 1):
            assert (grammar.slice(first, 20) == ids[first:first + 20]).all()
    assert len(grammar.symbols) < 0.5 * len(ids)
    assert len(repair.compress(np.zeros(0, np.uint32)).symbols) == 0


def test_token_files(spark, messy, nothing):
    tokenizer, rows = Tokenizer.from_file(TOKENIZER), messy_rows()
    texts = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    encoder = token_files.WordEncoder(TOKENIZER)
    samples = [t for _, t in texts] + ["don't <|endoftext|> \"q\" 12,5 ünï cødé 　x \x00end it's"]
    assert all(encoder.exact_by_words(t) for t in samples)
    got = sorted(token_files.token_digests(token_files.scratch_tokens(messy, TOKENIZER)).collect(), key=lambda r: r.start)
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == [d for d, _ in texts]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_files.token_digests(token_files.scratch_tokens(nothing, TOKENIZER)).count() == 0


def test_words_are_looked_up_once_per_batch():
    encoder, tokenizer = token_files.WordEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["x \x00END y", "z", "", " \t\n", "\x00end\x00END", "a<|b A.B", "1,5-x's \x1c\x85 \u00a0É.é", "word " * 500, "WORD."]
    plain = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for own in (texts, texts[:5], texts[6:]):  # with a special token's sign, and without
        got = encoder.encode([t.encode() for t in own])
        assert [g.tolist() for g in got] == [[*plain[texts.index(t)], repair.SEPARATOR] for t in own]
    asked = []

    class Counted(dict):
        def get(self, word, other=None):
            asked.append(word)
            return super().get(word, other)

    encoder.known = Counted(encoder.known)
    encoder.encode([b"word " * 500, b"WORD."])
    assert sorted(asked) == [b".", b"word"]


def test_lm_scores(messy, nothing):
    rows = messy_rows()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    got = lm.lm_scores(messy, remainder(F.col("doc_id"), 5) == 1).collect()
    tokens = [(d, [*space_words(t), None]) for d, t, *_ in rows]
    counts = Counter(w for d, words in tokens if not held(d) for w in words)
    n, v = sum(counts.values()), len(counts)
    base = lambda words: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    want = sorted(((d, held(d), len(w), sum(counts[x] > 0 for x in w), n, base(w)) for d, w in tokens), key=key)
    for r, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5]) and r[6] < 0
    assert lm.lm_scores(nothing, F.lit(False)).count() == 0
    assert {r.train_tokens for r in lm.lm_scores(messy, F.lit(True)).collect()} == {0}


def test_lm_probabilities_sum_to_one_and_beat_the_base(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    got = lm.lm_scores(docs, remainder(F.col("doc_id"), 5) == 1).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    model = lm.learn_model(docs)
    tokens = model.classes.tokens(pa.array([docs.first().text]))
    total = np.zeros(len(tokens.classes))
    for k in range(lm_model.CLASSES):
        wide, deep = model.weights.rows(tokens)
        group = np.full(len(total), k // lm_model.MEMBERS)
        (lg, _, sg), (lm_, _, sm) = model.weights._forward(wide, deep, group)
        total += np.exp(lg[:, group[0]] - np.log(sg) + lm_[:, k % lm_model.MEMBERS] - np.log(sm))
    assert np.allclose(total, 1, atol=1e-3)


def test_row_sums_are_those_of_sorted_runs():
    """Rows of every frequency, summed bit for bit as over the sorted rows; a step of learning moves the same weights."""
    rng = np.random.default_rng(3)
    for rows in (np.zeros(1, np.int64), np.arange(50), np.full(40, 65535), np.repeat(np.arange(30), np.arange(30)), rng.zipf(1.3, 4096) % 60000):
        rows = rng.permutation(rows)
        values = rng.standard_normal((len(rows), 32)).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        want, at = np.unique(rows[order], return_index=True)
        own, sums = lm_model.row_sums(values, rows)
        back = np.argsort(own)
        assert np.array_equal(own[back], want) and np.array_equal(sums[back], np.add.reduceat(values[order], at, axis=0))
        table = np.zeros((1 << 16, 32), np.float32)
        lm_model._put(table, own, sums)
        assert np.array_equal(table[want], sums[back]) and np.count_nonzero(table.any(1)) <= len(want)
    # radix sorting takes row numbers below 2^16
    assert max(lm_model.MaxEnt._WIDE[-1], lm_model.MaxEnt._DEEP[-1]) <= 1 << 16


def test_lm_steps_through_every_text(spark):
    texts = [f"context{i} follows" for i in range(64)]
    weights = (model := lm.learn_model(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).weights
    tokens = model.classes.tokens(pa.array(texts))
    after = weights.rows(tokens)[0][4][tokens.bounds[:-1] + 1]  # the row of each text's first word, zero until learned
    assert weights.wide[after].any(axis=1).all()


def test_lm_frequent_words_and_priors_are_of_all_texts(spark):
    early = random_key(F.col("id")) < KEY_RANGE // 2
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(early, "early").otherwise("late").alias("text"))
    n = docs.filter("text = 'late'").count()
    model = lm.learn_model(docs)
    word = model.classes.tokens(pa.array(["late"]))
    assert word.hashes[0] in model.classes.hashes
    prior = np.exp(model.weights.group_bias[word.classes[0] // lm_model.MEMBERS] + model.weights.member_bias.flat[word.classes[0]])
    assert prior == pytest.approx(n / 40_000, rel=0.02)


def test_language_id(spark, messy, nothing):
    got = catalog.op4_language_id(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    model = language.learn_languages(messy)
    found = language.identify(messy, model, ["doc_id", "text"]).select("doc.doc_id", "doc.text", "lang_pred", "score").collect()
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) if letters else (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert language.known_language(messy, model).dtypes == messy.dtypes
    assert language.learn_languages(nothing) is None
    assert language.identify(messy, None, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(nothing, model, ["doc_id"]).count() == 0


def test_known_language_by_share_of_known_ngrams(spark):
    known = lambda rows, *learned: sorted(r.text for r in language.known_language(
        spark.createDataFrame([(t,) for t in rows], "text string"),
        language.learn_languages(spark.createDataFrame(list(learned), "doc_id int, text string, lang string"))).collect())
    three = [(1, "the weather was good", "en"), (2, "das wetter wird kalt", "de"), (3, "il fera beau demain", "fr")]
    foreign = "zxqv kjwp the vbnmq plokij uhygtf rdesw"
    assert known([foreign, "weather", "wetter", "..."], *three) == ["weather", "wetter"]
    shared = [(1, "berlin", "en"), (2, "berlin", "de")]
    assert known(["berlin", "zxqv"], *shared) == ["berlin"]
    assert known(["berlin", "zxqv"], (1, "berlin", "en")) == ["berlin"]
    assert known(["berlin", "..."], (1, "berlin", None)) == known(["berlin", "..."], (1, "...", "en")) == ["...", "berlin"]


def test_language_filter_beyond_one_word_of_bits():
    own = [language.grams(pa.array([f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx " * 3]))[0] for i in range(70)]
    model = language.LanguageFilter([str(i) for i in range(70)], list(enumerate(own)))
    best, score = model.decide(pa.array([f"{chr(97 + i % 26)}{chr(97 + i // 26)}qx" for i in range(70)]))
    assert best.tolist() == list(range(70)) and (score > 0.5).all()


def test_toxicity(spark, messy, nothing):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.learn_toxicity(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    held = toxicity.score_toxicity(docs, model, ["doc_id"]).select("doc.doc_id", "score", "predicted").join(
        labels.filter(remainder(F.col("doc_id"), 4) == 2), "doc_id").collect()
    bad, good = ([r.score for r in held if r.toxic == k] for k in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) + 0.5 * np.mean([a == b for a in bad for b in good]) > 0.8
    scores = toxicity.score_toxicity(messy, model, ["doc_id"]).collect()
    assert len(scores) == messy.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores)
    assert toxicity.score_toxicity(nothing, model, ["doc_id"]).count() == 0
    blank = toxicity.learn_toxicity(docs, labels.filter("false"))
    assert toxicity.score_toxicity(messy, blank, ["doc_id"]).filter("score <> 0").count() == 0


def test_toxicity_features():
    terms = kernels.word_hashes(*[x for x in (lambda r, o: (r, o[:-1], o[1:]))(*kernels.text_bytes(pa.array(["idiot", "loser"])))])
    lexicon = toxicity.Lexicon(terms, np.array([2.0, 3.0]))
    rows = toxicity.features(pa.array(["You IDIOT, you!", "fine text here", "", None, "such an id1ot", "an i$iot"]), lexicon)
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert rows[0, at["word_density"]] == pytest.approx(1 / 3) and rows[0, at["near_second_person"]] > 0 and rows[0, at["shouted_words"]] > 0
    assert (rows[1, [at["any_density"], at["strongest"], at["disguised_density"]]] == 0).all() and (rows[2] == 0).all() and (rows[3] == 0).all()
    assert rows[4, at["disguised_density"]] > 0 and rows[4, at["digits_in_words"]] > 0 and rows[5, at["disguised_density"]] == 0


def test_decimals_and_group_ends_of_tokens():
    """Ids of every width come from a table of decimals; groups close where both sides end, behind tokens without bytes."""
    from types import SimpleNamespace

    from wayfolio.llm import token_alignment as ta

    rng = np.random.default_rng(5)
    for ids in ([0, 9, 10, 99, 100, 65535], [65536, 3, 1234567], [7], [], rng.integers(0, 1 << 16, 500)):
        ids = np.array(ids, np.int64)
        marks = np.frombuffer(b",;|" * len(ids), np.uint8)[:len(ids)]
        assert ta._decimals(ids, marks) == b"".join(b"%d%c" % p for p in zip(ids, marks, strict=True))[:-1]
    assert ta._SHORT[-1].tobytes() == b"0065535\0"
    side = lambda tokens: SimpleNamespace(ids=lambda text: np.arange(len(tokens)), vocabulary=ta._Vocabulary(tokens))
    for _ in range(50):
        raw = b" " + b"a" * int(rng.integers(1, 30))
        cuts = [np.sort(np.append(rng.integers(0, len(raw) + 1, int(rng.integers(0, 12))), [0, len(raw)])) for _ in range(2)]
        left, right = ([raw[a:z] for a, z in zip(c, c[1:])] for c in cuts)
        found = ta.Aligned(side(left), side(right), raw[1:].decode())
        both = np.intersect1d(cuts[0][1:], cuts[1][1:])
        both = both[both > 0]
        assert [found.to_a.tolist(), found.to_b.tolist()] == [np.searchsorted(c[1:], both, side="right").tolist() for c in cuts]
