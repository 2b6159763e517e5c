"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.llm.common import KEY_RANGE, random_key, small_batches, stored
from wayfolio.llm.decontamination import small
from wayfolio.llm.kernels import mix, text_bytes, word_hashes

#: Labelled texts to learn from, about; taken by a random key of the id. A third of them calibrates.
SAMPLE = 30_000
#: Most terms in the lexicon, the texts a term must be in, and its least log odds.
TERMS, TERM_TEXTS, TERM_ODDS = 20_000, 5, 1.5
#: Bytes of the word beginnings that are terms too, so that unseen endings of a known stem count.
STEM = 5
THRESHOLD = 0.3
#: Words within which an address in the second person counts as near.
NEAR = 6
# Second person in the languages of the corpus.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes",
    "vous", "votre", "vos", "ti", "contigo", "usted", "ustedes", "vosotros",
)

FEATURES = (
    "log_words", "word_density", "stem_density", "any_density", "log_hits", "weight_density", "strongest", "most_of_ten", "second_person",
    "near_second_person", "capitals", "shouted_words", "punctuation", "exclamations", "questions", "repeats", "symbols_in_words",
    "digits_in_words", "disguised_density", "digits",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# What stands for which letter in a disguised word.
_DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"}
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in _DISGUISE.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in _DISGUISE]] = True
#: Sets the hashes of stems apart from those of words.
_STEM_SALT = np.uint64(0x5DEECE66D)


def _runs(inside: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of true, cut where a text begins, and per text the first of its stretches."""
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(inside & before)
    return starts, np.flatnonzero(inside & after) + 1, np.searchsorted(starts, offsets)


class Words:
    """The words of a batch (runs of letters and digits) and their hashes, whole and cut to a stem."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = text_bytes(column)
        self.starts, self.ends, self.per_text = _runs(_LETTER[self.raw] | _DIGIT[self.raw], self.offsets, len(self.raw))
        self.count = np.diff(self.per_text)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.whole = word_hashes(self.raw, self.starts, self.ends)
        self.stem = mix(word_hashes(self.raw, self.starts, np.minimum(self.ends, self.starts + STEM)) ^ _STEM_SALT)
        self.long = self.ends - self.starts >= STEM

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=len(self.count))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (term, bad, good): in how many texts of each label a term is, per batch."""
    for batch in batches:
        words, label = Words(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        owner = np.concatenate([words.owner, words.owner[words.long]]).astype(np.uint64)
        term = np.concatenate([words.whole, words.stem[words.long]])
        if not len(term):
            continue
        order = np.lexsort((owner, term))
        term, owner = term[order], owner[order]
        once = np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])])
        term, bad = term[once], label[owner[once].astype(np.int64)] == 1
        at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        yield pa.RecordBatch.from_arrays([
            pa.array(term[at].view(np.int64)), pa.array(np.add.reduceat(bad.astype(np.int64), at)),
            pa.array(np.add.reduceat((~bad).astype(np.int64), at)),
        ], ["term", "bad", "good"])


class Lexicon:
    """At most TERMS hashes with a weight each; a small table of bits spares most words the search."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order].astype(float)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        likely = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(likely) and len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, hashes[likely]), len(self.terms) - 1)
            out[likely] = np.where(self.terms[at] == hashes[likely], self.weights[at], 0.0)
        return out


def _address() -> np.ndarray:
    raw, offsets = text_bytes(pa.array(SECOND_PERSON))
    return np.sort(word_hashes(raw, offsets[:-1], offsets[1:]))


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text."""
    w = Words(column)
    raw, n, size = w.raw, np.maximum(w.count, 1), np.maximum(np.diff(w.offsets), 1)
    whole, stem = lexicon.weigh(w.whole), np.where(w.long, lexicon.weigh(w.stem), 0.0)
    weight = np.maximum(whole, stem)
    hit = weight > 0
    hits = w.word_sums(hit)

    address = _address()
    you = address[np.minimum(np.searchsorted(address, w.whole), len(address) - 1)] == w.whole
    near = np.zeros(len(hit), bool)
    if len(hit):  # words to the nearest address of the same text, on either side
        spots = np.flatnonzero(you)
        if len(spots):
            at = np.arange(len(hit))
            right = np.minimum(np.searchsorted(spots, at), len(spots) - 1)
            left = np.maximum(right - 1, 0)
            for side in (left, right):
                near |= (np.abs(spots[side] - at) <= NEAR) & (w.owner[spots[side]] == w.owner)
    seen = np.concatenate([[0], np.cumsum(hit)])
    begin = np.maximum(np.arange(len(hit)) - 9, w.per_text[:-1][w.owner] if len(hit) else 0)
    of_ten = seen[1:] - seen[begin] if len(hit) else np.zeros(0)
    strongest, most = np.zeros(len(n)), np.zeros(len(n))
    np.maximum.at(strongest, w.owner[hit], weight[hit])
    np.maximum.at(most, w.owner[hit], of_ten[hit])

    upper = (raw >= 0x41) & (raw <= 0x5A)
    letter, digit = _LETTER[raw], _DIGIT[raw]
    other = ~(letter | digit | _SPACE[raw])
    total_upper = np.concatenate([[0], np.cumsum(upper)])
    total_lower = np.concatenate([[0], np.cumsum(letter & ~upper)])
    shouted = (total_upper[w.ends] - total_upper[w.starts] >= 2) & (total_lower[w.ends] == total_lower[w.starts])
    total_digit = np.concatenate([[0], np.cumsum(digit)])
    total_letter = np.concatenate([[0], np.cumsum(letter)])
    mixed = (total_digit[w.ends] > total_digit[w.starts]) & (total_letter[w.ends] > total_letter[w.starts])
    inner, thrice = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & ~_SPACE[raw[1:-1]]
        thrice[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (letter | other)[2:]
        for side in (-1, 0):  # a byte's neighbours are bytes of its own text
            inner[np.clip(w.offsets + side, 0, len(raw) - 1)] = False
        for side in (0, 1):
            thrice[np.clip(w.offsets + side, 0, len(raw) - 1)] = False
    disguised = _disguised(raw, w.offsets, letter, inner, lexicon)

    rows = np.stack([
        np.log1p(w.count), w.word_sums(whole > 0) / n, w.word_sums(stem > 0) / n, hits / n, np.log1p(hits), w.word_sums(weight) / n,
        strongest, most, w.word_sums(you) / n, w.word_sums(hit & near) / n, w.sums(upper) / np.maximum(w.sums(letter), 1),
        w.word_sums(shouted) / n, w.sums(other) / size, w.sums(raw == 0x21) / size, w.sums(raw == 0x3F) / size, w.sums(thrice) / size,
        w.sums(inner) / n, w.word_sums(mixed) / n, disguised / n, w.sums(digit) / size,
    ], axis=1)
    return rows


def _disguised(raw, offsets, letter, inner, lexicon) -> np.ndarray:
    """Per text, lexicon words that show only after signs inside words are read as the letters they stand for."""
    signs = inner & _SIGN[raw]
    if not signs.any():
        return np.zeros(len(offsets) - 1)
    starts, ends, per_text = _runs(letter | signs, offsets, len(raw))
    held = np.concatenate([[0], np.cumsum(signs)])
    odd = held[ends] > held[starts]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(per_text))[odd]
    found = lexicon.weigh(word_hashes(np.where(signs, _PLAIN[raw], raw), starts[odd], ends[odd])) > 0
    return np.bincount(owner, weights=found, minlength=len(offsets) - 1)


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc, text) get ``features`` instead of the text."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = features(batch.column(1), sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc", "features"])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", "text").mapInArrow(run, f"doc {kind}, features array<double>")


@dataclass
class ToxicityModel:
    """What was learned. Without texts of both labels there are no trees, and ``rate`` is every score."""

    rate: float
    lexicon: Lexicon | None = None
    trees: object = None
    scale: object = None


def _raw_score(trees, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def learn_toxicity(docs: DataFrame, labels: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "toxic",
                   sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon, trees and calibration from about ``sample`` labelled texts of ``docs``.

    The sample is the labels whose id has a small random key. Terms are counted where the texts are; the driver gets at
    most TERMS of them. An id with several labels counts as toxic if one of them is 1; null labels are none.
    """
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(identity).alias("of")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    known = marks.agg(F.count("*"), F.avg("toxic")).first()
    share = min(1.0, sample / max(1, known[0]))
    picked = stored(marks.withColumn("key", random_key(F.col("of"))).filter(F.col("key") < F.lit(share * KEY_RANGE)), "labels")
    rows = docs.select(F.col(identity).alias("id"), F.col(text).cast("string").alias("text")).join(small(picked), F.col("id") == F.col("of"))
    rows = stored(rows.select(F.struct("toxic", "key").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), "labelled")
    fit, rest = (rows.filter((F.col("doc.key") % 3 == 0) == side) for side in (False, True))
    classes = {r[0] for r in fit.select("doc.toxic").distinct().collect()}
    if len(classes) < 2 or rest.isEmpty():
        return ToxicityModel(float(known[1] or 0.0))

    counts = fit.select("text", "doc.toxic").mapInArrow(_term_counts, "term bigint, bad bigint, good bigint")
    totals = {r[0]: r[1] for r in fit.groupBy("doc.toxic").count().collect()}
    sums = counts.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= TERM_TEXTS)
    odds = F.log((F.col("bad") + 0.5) / totals[1]) - F.log((F.col("good") + 0.5) / totals[0])
    best = sums.withColumn("odds", odds).filter(F.col("odds") >= TERM_ODDS).orderBy(F.desc("odds"), "term").limit(TERMS).toPandas()
    lexicon = Lexicon(best["term"].to_numpy(np.int64).view(np.uint64), best["odds"].to_numpy(float))

    ready = stored(with_features(rows, lexicon).select("doc.toxic", "doc.key", "features"), "training")
    fit, rest = (ready.filter((F.col("key") % 3 == 0) == side) for side in (False, True))
    vectors = fit.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("toxic").cast("double")).select("vector", "label")
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxDepth=4, maxIter=20, stepSize=0.3, maxBins=64, seed=7).fit(vectors)
    raw = _raw_score(trees, rest).select("raw", F.col("toxic").cast("double").alias("label"))
    return ToxicityModel(float(known[1]), lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc`` (a struct of the columns ``keep``, so no name can clash), score and predicted.

    * Texts are read whole; a null text counts as empty, and empty texts get the score their features call for.
    * Equal texts get equal scores. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if model.trees is None:
        scored = rows.select("doc", F.lit(model.rate).alias("score"))
    else:
        raw = _raw_score(model.trees, with_features(rows, model.lexicon))
        scored = model.scale.transform(raw).select("doc", _between(F.col("prediction")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _between(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
