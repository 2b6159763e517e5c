"""Languages and toxicity against versions in plain Python, text by text."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wayfolio.llm import kernels, language, toxicity
from wayfolio.llm.common import random_key, table
from samples import messy, messy_rows, sentence  # noqa: F401

SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}


def low_bytes(text):
    """Letters in lower case, one space for each other byte."""
    out = bytearray()
    raw = (text or "").encode()
    for i, b in enumerate(raw):
        if 0x41 <= b <= 0x5A or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97):
            out.append(b + 32)
        else:
            out.append(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    return bytes(out)


def plain_grams(text):
    body = b" " + low_bytes(text)
    while b"  " in body:
        body = body.replace(b"  ", b" ")
    body += b" "
    return [int.from_bytes(body[i:i + 4], "little") for i in range(len(body) - 3)]


class PlainLanguages:
    """A set of slots per language, over the n-grams that are frequent in it and not much rarer than elsewhere."""

    def __init__(self, labelled):
        counts, texts = defaultdict(Counter), Counter()
        for text, lang in labelled:
            if text is not None and lang is not None:
                counts[lang].update(plain_grams(text))
                texts[lang] += 1
        rates = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
        best = Counter()
        for own in rates.values():
            for g, rate in own.items():
                best[g] = max(best[g], rate)
        self.langs = sorted(texts, key=lambda k: (-texts[k], k))
        self.held = {lang: {s for g, rate in rates[lang].items() if rate >= language.RATE and rate >= language.OF_BEST * best[g]
                            for s in self.slots(g)} for lang in self.langs}

    @staticmethod
    def slots(gram):
        return [(gram * p & 0xFFFFFFFF) >> (32 - language.SLOT_BITS) for p in (0x9E3779B1, 0x85EBCA77)]

    def __call__(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        grams, found = plain_grams(text), []
        for lang in self.langs:
            by_chance = (len(self.held[lang]) / (1 << language.SLOT_BITS)) ** 2
            matches = sum(all(s in self.held[lang] for s in self.slots(g)) for g in grams)
            found.append(max(0.0, (matches - len(grams) * by_chance) / (1 - by_chance)))
        top = max(found)
        second = sorted(found)[-2] if len(found) > 1 else 0.0
        return self.langs[found.index(top)], top / (top + second) if top > 0 else 1 / len(found)


def check_languages(learned, asked):
    rows = [(r.doc_id, r.text, r.lang) for r in learned.select("doc_id", "text", "lang").collect()]
    plain = PlainLanguages([(t, lang) for _, t, lang in rows])
    model = language.learn_languages(learned)
    assert model.langs == plain.langs
    seen = Counter()
    for r in language.identify(asked, model, ["text"]).select("doc.text", "lang_pred", "score").collect():
        lang, score = plain(r.text)
        assert r.score == pytest.approx(score, abs=1e-9)
        seen[lang == r.lang_pred] += 1
        assert lang == r.lang_pred or score == pytest.approx(0.5)
    assert seen[True] > 0.98 * seen.total()


def test_languages_equal_sets_of_ngrams(spark, messy):
    docs = table(spark, SMALL, "documents")
    check_languages(docs.filter("doc_id % 4 <> 1"), docs)
    awkward = ["É ß ñ À×Þ", "a", " b ", "x  y", "...", "weather 12 today", "日本語 text", "the\tquick\nbrown  ", ""]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(awkward)]
    learned = messy.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    check_languages(learned, learned)


def runs(raw, inside):
    """(start, end) of the stretches of bytes that ``inside`` accepts."""
    out, start = [], None
    for i in range(len(raw) + 1):
        if i < len(raw) and inside(i):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def plain_features(text, words, stems):
    """``words`` and ``stems``: weights by lower-cased bytes."""
    raw = (text or "").encode()
    letter = lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    digit = lambda b: 0x30 <= b <= 0x39
    space = lambda b: b == 0x20 or 0x09 <= b <= 0x0D
    upper = lambda b: 0x41 <= b <= 0x5A
    other = lambda b: not (letter(b) or digit(b) or space(b))
    low = lambda bs: bytes(b + 32 if upper(b) else b for b in bs)
    own = [raw[a:b] for a, b in runs(raw, lambda i: letter(raw[i]) or digit(raw[i]))]
    count, n, size = len(own), max(len(own), 1), max(len(raw), 1)
    whole = [words.get(low(w), 0.0) for w in own]
    stem = [stems.get(low(w[:5]), 0.0) if len(w) >= 5 else 0.0 for w in own]
    weight = [max(a, b) for a, b in zip(whole, stem, strict=True)]
    hit = [w > 0 for w in weight]
    you = [low(w).decode("utf-8", "replace") in toxicity.SECOND_PERSON for w in own]
    near = sum(h and any(you[max(0, i - 6):i + 7]) for i, h in enumerate(hit))
    of_ten = [sum(hit[max(0, i - 9):i + 1]) for i in range(count) if hit[i]]
    inner = [0 < i < len(raw) - 1 and letter(raw[i - 1]) and letter(raw[i + 1]) and not letter(b) and not space(b) for i, b in enumerate(raw)]
    thrice = [i >= 2 and raw[i] == raw[i - 1] == raw[i - 2] and (letter(raw[i]) or other(raw[i])) for i in range(len(raw))]
    sign = [inner[i] and chr(b) in SIGNS for i, b in enumerate(raw)]
    read = bytes(ord(SIGNS[chr(b)]) if sign[i] else b for i, b in enumerate(raw))
    disguised = sum(words.get(low(read[a:b]), 0) > 0 for a, b in runs(raw, lambda i: letter(raw[i]) or sign[i]) if any(sign[a:b]))
    return [
        math.log1p(count), sum(w > 0 for w in whole) / n, sum(s > 0 for s in stem) / n, sum(hit) / n, math.log1p(sum(hit)), sum(weight) / n,
        max(weight, default=0.0), max(of_ten, default=0), sum(you) / n, near / n, sum(map(upper, raw)) / max(sum(map(letter, raw)), 1),
        sum(sum(map(upper, w)) >= 2 and not any(letter(b) and not upper(b) for b in w) for w in own) / n, sum(map(other, raw)) / size,
        raw.count(b"!") / size, raw.count(b"?") / size, sum(thrice) / size, sum(inner) / n,
        sum(any(map(digit, w)) and any(map(letter, w)) for w in own) / n, disguised / n, sum(map(digit, raw)) / size,
    ]


def hashed(names):
    raw, offsets = kernels.text_bytes(pa.array(names))
    return kernels.word_hashes(raw, offsets[:-1], offsets[1:])


def test_features_equal_plain_ones(spark):
    given = {"idiot": 2.0, "loser": 3.0, "fox": 1.6, "jumps": 1.7}
    begins = {"wizar": 1.9, "idiot": 2.5}
    lexicon = toxicity.Lexicon(
        np.concatenate([hashed(list(given)), kernels.mix(hashed(list(begins)) ^ toxicity._STEM_SALT)]),
        np.array([*given.values(), *begins.values()]))
    words, stems = ({k.encode(): v for k, v in d.items()} for d in (given, begins))
    texts = [t for _, t, *_ in messy_rows()] + [
        "You IDIOT, you!", "such an id1ot and an i$iot", "LOSER loser L0SER!!! ???", "idiotic 4U2 you fox " * 9, "!!!!", "é@é", "a1 1a", "1d1ot",
        "tu idiot one two three four five six seven idiot you",
    ]
    texts += [r.text[:4000] for r in table(spark, SMALL, "documents").filter("doc_id % 10 = 3 AND text IS NOT NULL").collect()]
    got = toxicity.features(pa.array(texts, pa.string()), lexicon)
    for text, row in zip(texts, got, strict=True):
        assert dict(zip(toxicity.FEATURES, row, strict=True)) == pytest.approx(
            dict(zip(toxicity.FEATURES, plain_features(text, words, stems), strict=True))), text


def adjacent_violators(points):
    """[(first raw, last raw, value)] of the rising step function nearest to (raw, label)."""
    sums = defaultdict(lambda: [0.0, 0])
    for raw, label in points:
        sums[raw][0] += label
        sums[raw][1] += 1
    blocks = []
    for raw in sorted(sums):
        blocks.append([raw, raw, *sums[raw]])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, last, total, n = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + total, blocks[-1][3] + n]
    return [(a, b, total / n) for a, b, total, n in blocks]


def test_lexicon_and_calibration_equal_plain_ones(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.01", "labels").filter("doc_id % 4 <> 2")
    model = toxicity.learn_toxicity(docs, labels)
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.join(marks, "doc_id").withColumn("third", random_key(F.col("doc_id")) % 3).collect()

    seen, totals = defaultdict(Counter), Counter()
    for r in rows:
        if r.third != 0:
            totals[r.toxic] += 1
            raw = (r.text or "").encode()
            own = [raw[a:b].lower() for a, b in runs(raw, lambda i: chr(raw[i]).isascii() and chr(raw[i]).isalnum() or raw[i] >= 0x80)]
            seen[r.toxic].update({(0, w) for w in own} | {(1, w[:5]) for w in own if len(w) >= 5})
    odds = {t: math.log((n + 0.5) / totals[1]) - math.log((seen[0][t] + 0.5) / totals[0]) for t, n in seen[1].items() if n >= toxicity.TERM_TEXTS}
    kept = sorted((v for v in odds.values() if v >= toxicity.TERM_ODDS), reverse=True)
    assert sorted(model.lexicon.weights, reverse=True) == pytest.approx(kept) and kept

    scored = toxicity._raw_score(model.trees, toxicity.with_features(
        docs.join(marks, "doc_id").select(F.struct("doc_id", "toxic").alias("doc"), "text"), model.lexicon)).select("doc.*", "raw").collect()
    third = {r.doc_id: r.third for r in rows}
    steps = adjacent_violators([(r.raw, r.toxic) for r in scored if third[r.doc_id] == 0])
    xs, ys = zip(*[(x, y) for a, b, y in steps for x in dict.fromkeys((a, b))], strict=True)
    want = {r.doc_id: float(np.interp(r.raw, xs, ys)) for r in scored}
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model, ["doc_id"]).select("doc.doc_id", "score").collect() if r.doc_id in want}
    assert got == pytest.approx(want, abs=1e-9)
