"""Language identification by one bit-sliced Bloom filter: an n-gram yields the bitmask of languages that hold it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfolio.llm.common import KEY_RANGE, random_key, small_batches
from wayfolio.llm.kernels import text_bytes

#: Labelled texts read per language, about; taken by a random key of the id.
SAMPLE = 5000
#: An n-gram belongs to a language if it makes up this share of its n-grams, so a language has at most 1 / RATE of them,
#: and this share of what it makes up in the language where it is most frequent, so stray labels don't add any.
RATE, OF_BEST = 2e-5, 0.1
#: Slots of the filter, as a power of two; fixed, whatever the size of the input.
SLOT_BITS = 20
UNDETERMINED = "und"
#: A text is in a known language if this share of its n-grams is that language's. At sf0.01 every text has 0.51 or more;
#: with its language left out of the learning, half of them have 0.20 or less and all but one in a hundred 0.37 or less.
LEAST_KNOWN = 0.25

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_PROBES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All 4-byte windows of the lower-cased texts, one space for whatever is no letter; per text (first, end) of them."""
    raw, offsets = text_bytes(column)
    low = _LETTERS[raw]
    if len(raw) > 1:  # capitals of the Latin-1 block, as UTF-8 writes them
        high = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][high] += 0x20
    low = np.append(np.insert(low, offsets[:-1], 0x20), np.uint8(0x20))
    begins = np.append(offsets[:-1] + np.arange(len(offsets) - 1), len(low) - 1)
    blank = low == 0x20
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[begins] = True
    at = np.concatenate([[0], np.cumsum(keep)])[begins]
    b = low[keep].astype(np.uint32)
    if len(b) < 4:
        none = np.zeros(len(offsets) - 1, np.int64)
        return np.zeros(0, np.uint32), none, none
    windows = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    first = np.minimum(at[:-1], len(windows))
    return windows, first, np.minimum(np.maximum(first, at[1:] - 2), len(windows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), counted per batch."""
    for batch in batches:
        windows, first, end = grams(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(langs):
            own = np.flatnonzero(langs == lang)
            if len(windows) and (parts := [windows[first[i]:end[i]] for i in own]):
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


class LanguageFilter:
    """``slots[i]`` has bit l set if an n-gram of language l probes slot i; languages beyond 64 take further columns."""

    def __init__(self, langs: list[str], pairs):
        """``langs``: most frequent first. ``pairs``: (index of the language, array of its n-grams)."""
        self.langs = langs
        kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(langs) <= bits), np.uint64)
        self.slots = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), kind)
        for l, own in pairs:
            for slot in self._slots(own.astype(np.uint32)):
                self.slots[l // 64, slot] |= kind(1 << l % 64)
        self.false = np.array([np.mean(self._bit(self.slots[l // 64], l % 64)) ** len(_PROBES) for l in range(len(langs))])

    @staticmethod
    def _slots(windows: np.ndarray) -> list[np.ndarray]:
        return [(windows * p) >> np.uint32(32 - SLOT_BITS) for p in _PROBES]

    @staticmethod
    def _bit(masks: np.ndarray, bit: int) -> np.ndarray:
        return (masks >> masks.dtype.type(bit)) & masks.dtype.type(1)

    def decide(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score for each text."""
        return self.matches(column)[:2]

    def matches(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its score and the share of the text's n-grams that are the language's, for each text.

        Matches of a language among n n-grams are corrected by the n * false that fit by chance. The score is the best
        count's share of the best two; ties go to the more frequent language.
        """
        windows, first, end = grams(column)
        n = (end - first).astype(float)
        probes = self._slots(windows)
        counts = np.zeros((len(self.langs), len(first)))
        for block, slots in enumerate(self.slots):
            masks = slots[probes[0]]
            for slot in probes[1:]:
                masks &= slots[slot]
            for bit in range(min(64, len(self.langs) - 64 * block)):
                sums = np.concatenate([[0], np.cumsum(self._bit(masks, bit), dtype=np.int64)])
                counts[64 * block + bit] = sums[end] - sums[first]
        counts = np.maximum(0, (counts - n * self.false[:, None]) / np.maximum(1e-9, 1 - self.false[:, None]))
        best = counts.argmax(0)
        top = counts[best, np.arange(len(best))]
        second = np.sort(counts, 0)[-2] if len(self.langs) > 1 else np.zeros(len(best))
        return best, np.where(top > 0, top / np.maximum(top + second, 1e-9), 1 / len(self.langs)), top / np.maximum(n, 1)


def learn_languages(labelled: DataFrame, identity: str = "doc_id", text: str = "text", lang: str = "lang",
                    sample: int = SAMPLE) -> LanguageFilter | None:
    """The filter over the languages in ``lang``, from about ``sample`` texts of each; None without labelled texts.

    n-grams are counted where the texts are; the driver gets at most 1 / RATE of them per language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), random_key(F.col(identity)).alias("key"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    bound = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n) * KEY_RANGE))), F.col("lang"))
    counts = rows.filter(F.col("key") < bound).select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    own = rates.filter(F.col("rate") >= RATE).join(best, "gram").filter(F.col("rate") >= OF_BEST * F.col("best"))
    found = own.select("lang", "gram").toPandas()
    langs = sorted(sizes, key=lambda k: (-sizes[k], k))
    held = {k: g["gram"].to_numpy() for k, g in found.groupby("lang")}
    return LanguageFilter(langs, [(i, held[k]) for i, k in enumerate(langs) if k in held])


def identify(docs: DataFrame, model: LanguageFilter | None, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``doc`` (a struct of the columns ``keep``, so no name can clash), lang_pred, score and matched.

    ``matched`` is the share of the text's n-grams that are the language's, less those that fit by chance.

    * A text that is null or has no letter is ``und`` with score and share 0, and so is every text if nothing was learned.
    * A text with letters but no known n-gram gets the most frequent language with score 1 / languages.
    * Texts are read whole; equal texts get equal results. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("doc"), F.col(text).cast("string").alias("text"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("matched"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*sent.value.langs, UNDETERMINED], pa.string())
        for batch in batches:
            best, score, matched = sent.value.matches(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred = names.take(pa.array(np.where(letters, best, len(names) - 1)))
            score, matched = (pa.array(np.where(letters, x, 0.0)) for x in (score, matched))
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, score, matched], ["doc", "lang_pred", "score", "matched"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, matched double"
    return rows.mapInArrow(run, schema)


def known_language(docs: DataFrame, model: LanguageFilter | None, text: str = "text") -> DataFrame:
    """``docs`` without those whose language can't be told: ``und``, no known n-gram in them, or a share of known ones below
    ``LEAST_KNOWN``; same columns. If nothing was learned, all of them are kept."""
    if model is None or not model.slots.any():
        return docs
    rows = identify(docs, model, docs.columns, text)
    told = (F.col("matched") > 0) & (F.col("matched") >= LEAST_KNOWN)
    return rows.filter((F.col("lang_pred") != UNDETERMINED) & told).select("doc.*")
