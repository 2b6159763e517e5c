"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Texts are shuffled by their full text, so each distinct text is tokenised and aligned once, however often it occurs; its id
pairs count once for each of its documents. Pair counts are sums over blocks of texts, then over the corpus. The counts go
back to the blocks that asked, where the measures of each text are taken, and these join the documents by a text's digest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayfolio.llm.common import filled, small_batches, stored

#: Texts of about so many bytes are aligned and stored together.
BLOCK_BYTES = 4 << 20
#: Links of one step; a longer list of links is folded step by step.
LINKS = 1 << 22
#: Bytes that stand for themselves in a byte-level vocabulary; the others follow in order from code point 256 on.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LEAD = " "


class _Vocabulary:
    """The bytes of every id, and its decimal form with room for one separator."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def spells(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the ids' bytes, joined, are ``raw``; compared in steps, so a long text needs no long arrays."""
        if (ends[-1] if len(ends) else 0) != len(raw):
            return False
        for a in range(0, len(ids), LINKS // 8):
            own, size = ids[a:a + LINKS // 8], self.size[ids[a:a + LINKS // 8]]
            at = ends[a] - size[0]
            total = int(size.sum())
            places = np.repeat(self.begin[own] - (np.cumsum(size) - size), size) + np.arange(total)
            if not np.array_equal(self.flat[places], raw[at:at + total]):
                return False
        return True


def byte_level_bytes(entry: str) -> bytes:
    """The bytes that an entry of a byte-level vocabulary stands for."""
    return bytes(_BYTE_OF[c] for c in entry) if all(c in _BYTE_OF for c in entry) else entry.encode()


_BYTE_OF = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PLAIN_BYTES))}


class ByteLevel:
    """Ids of a byte-level tokenizer file; the strings of special tokens are ordinary text.

    With the same vocabulary given as ranks too, texts are encoded by them, which takes a fifth of the time. The ranks are
    used only if they spell the file's vocabulary id by id, and both agree on a few awkward texts.
    """

    AWKWARD = (" it's 10,000 km\t\n  of 漢字 \U0001F600‍ and <|endoftext|>'ll\r\n\x00 x́  ", "   ", "  a''S 've1½٠")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            tokens[i] = byte_level_bytes(entry)
        self.vocabulary = _Vocabulary(tokens)
        self.fast = None
        if ranks and pattern:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
            if all(tokens[i] == t for t, i in known.items()) and all(fast.encode_ordinary(t) == self._slow([t])[0] for t in self.AWKWARD):
                self.fast = fast

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self._slow([text])[0], np.int64)


class Pieces:
    """Ids of a sentencepiece model; it puts a space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = _Vocabulary([self._bytes(i) for i in range(self.model.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", LEAD).encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


def _plain_decimals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digits, right-aligned with a free place behind them; number of digits) of each id."""
    out = np.zeros((len(ids), WIDTH + 1), np.uint8)
    digits = np.ones(len(ids), np.int64)
    rest = ids.copy()
    for k in range(WIDTH):
        out[:, WIDTH - 1 - k] = 48 + rest % 10
        rest //= 10
        digits += rest > 0
    return out, np.minimum(digits, WIDTH)


WIDTH = 7
#: Decimals of the ids below 2^16, as one 8-byte item each, and which of the eight bytes are theirs.
_SHORT, _SHORT_DIGITS = _plain_decimals(np.arange(1 << 16))
_SHORT_USED = np.arange(WIDTH + 1) >= (WIDTH - _SHORT_DIGITS)[:, None]


def _decimals(ids: np.ndarray, marks: np.ndarray) -> bytes:
    """Each id in decimal, followed by its mark; without the last mark."""
    if len(ids) and ids.max() < len(_SHORT):
        out = _SHORT.view(np.uint64)[:, 0][ids].view(np.uint8).reshape(-1, WIDTH + 1)
        used = _SHORT_USED.view(np.uint64)[:, 0][ids].view(bool)
    else:
        out, digits = _plain_decimals(ids)
        used = (np.arange(WIDTH + 1) >= (WIDTH - digits)[:, None]).ravel()
    out[:, WIDTH] = marks
    return out.ravel()[used].tobytes()[:-1]


class Aligned:
    """Groups of one text: ids of both sides, and where each group ends on either side."""

    def __init__(self, left, right, text: str):
        raw = np.frombuffer((LEAD + text).encode(), np.uint8) if text else np.zeros(0, np.uint8)
        self.a = self.b = np.zeros(0, np.int64)
        if text:
            a, b = left.ids(LEAD + text), right.ids(text)
            a_ends, b_ends = left.vocabulary.ends(a), right.vocabulary.ends(b)
            if left.vocabulary.spells(a, a_ends, raw) and right.vocabulary.spells(b, b_ends, raw):
                self.a, self.b = a, b
        if not len(self.a):
            self.to_a = self.to_b = np.zeros(0, np.int64)
            return
        # a token without bytes ends where the one before it does: a group closes behind the last of equal ends
        # both end at the last byte, so the next end on the other side exists
        closes = np.flatnonzero(np.append(a_ends[1:] > a_ends[:-1], True) & (a_ends > 0))
        next_b = np.searchsorted(b_ends, a_ends[closes], side="right")
        same = b_ends[next_b - 1] == a_ends[closes]
        self.to_a, self.to_b = closes[same] + 1, next_b[same]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.to_a, prepend=0), np.diff(self.to_b, prepend=0)

    def digest(self) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        if not len(self.a):
            return ""
        n_a, n_b = self.sizes()
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + np.repeat(self.to_b - n_b, n_a)
        at_b = np.arange(len(self.b)) + np.repeat(self.to_a, n_b)
        ids[at_a], ids[at_b] = self.a, self.b
        marks[at_a[self.to_a - 1]], marks[at_b[self.to_b - 1]] = ord("|"), ord(";")
        sha, step = hashlib.sha256(), LINKS // 8
        for k in range(0, len(ids), step):
            piece = _decimals(ids[k:k + step], marks[k:k + step])
            sha.update(piece if k + step >= len(ids) else piece + bytes(marks[k + step - 1:k + step]))
        return sha.hexdigest()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct id pairs as a << 32 | b, how often each is linked). Groups beyond a step are folded by ids first."""
        n_a, n_b = self.sizes()
        pairs, times = [], []
        large = n_a * n_b > LINKS // 16
        step_of = np.cumsum(np.where(large, 0, n_a * n_b)) // LINKS
        for step in np.unique(step_of):
            own = (step_of == step) & ~large
            of_a, wide = np.repeat(own, n_a), np.repeat(n_b, n_a)
            first = np.repeat(self.to_b - n_b, n_a)[of_a]
            wide = wide[of_a]
            at_b = np.repeat(first - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
            found, count = np.unique(np.repeat(self.a[of_a] << 32, wide) | self.b[at_b], return_counts=True)
            pairs.append(found)
            times.append(count)
        for g in np.flatnonzero(large):
            a, of_a = np.unique(self.a[self.to_a[g] - n_a[g]:self.to_a[g]], return_counts=True)
            b, of_b = np.unique(self.b[self.to_b[g] - n_b[g]:self.to_b[g]], return_counts=True)
            for k in range(len(a)):
                pairs.append(a[k] << 32 | b)
                times.append(of_a[k] * of_b)
        if len(pairs) == 1:
            return pairs[0], times[0]
        return _folded(pairs, times) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _folded(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, np.concatenate(values))
    return found, sums


def _packed(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


_STORE = pa.schema([
    ("block", pa.string()), ("texts", pa.list_(pa.string())), ("measures", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
    ("pairs", pa.binary()), ("weights", pa.binary()), ("used", pa.list_(pa.int64())), ("links", pa.binary()), ("times", pa.binary()),
])
_STORE_DDL = "block string, texts array<string>, measures array<bigint>, digests array<string>, pairs binary, weights binary, used array<bigint>, links binary, times binary"


def _align(make_left, make_right):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = make_left(), make_right()
        rows: list[tuple] = []
        weight = 0

        def block() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, at, np.repeat([r[5] for r in rows], [len(r[3]) for r in rows]))
            values = [
                rows[0][0], [r[0] for r in rows], [m for r in rows for m in r[1]], [r[2] for r in rows], _packed(pairs), _packed(weights),
                [len(r[3]) for r in rows], _packed(at.astype(np.uint32)), _packed(np.concatenate([r[4] for r in rows]).astype(np.int64)),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _STORE, strict=True)], schema=_STORE)

        for batch in batches:
            for i in range(batch.num_rows):
                sha, text, copies = (batch.column(k)[i].as_py() for k in range(3))
                found = Aligned(left, right, text)
                links, times = found.links()
                rows.append((sha, (len(found.a), len(found.b), len(found.to_a), int(times.sum())), found.digest(), links, times, copies))
                weight += len(text) + 64
                if weight >= BLOCK_BYTES:
                    yield block()
                    rows, weight = [], 0
        if rows:
            yield block()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pair of a block."""
    for batch in batches:
        for name, pairs, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, weights = _unpacked(pairs, np.int64), _unpacked(weights, np.int64)
            for k in range(0, len(pairs), 1 << 16):
                own = pairs[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(own), pa.string()), pa.array((own >> 32).astype(np.int32)),
                    pa.array((own & 0xFFFFFFFF).astype(np.int32)), pa.array(weights[k:k + (1 << 16)]),
                ], names=["block", "a", "b", "weight"])


def _measured(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """The measures of one block's texts, from the counts of its pairs."""
    out = {"sha": [], "digest": [], "values": []}
    counts = counts.sort_by([("a", "ascending"), ("b", "ascending")])
    n, best = counts["n"].to_numpy(), counts["best"].to_numpy()
    for row in blocks.to_pylist():
        links, times = _unpacked(row["links"], np.uint32), _unpacked(row["times"], np.int64)
        used = np.array(row["used"], np.int64)
        text = np.repeat(np.arange(len(used)), used)
        own = n[links]
        n_best, count_sum = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        np.add.at(n_best, text, np.where(own == best[links], times, 0))
        np.add.at(count_sum, text, own * times)
        out["sha"] += row["texts"]
        out["digest"] += row["digests"]
        out["values"] += np.column_stack([np.array(row["measures"], np.int64).reshape(-1, 4), n_best, count_sum]).tolist()
    return pa.table({
        "sha": pa.array(out["sha"], pa.string()), "digest": pa.array(out["digest"], pa.string()),
        **{m: pa.array([v[i] for v in out["values"]], pa.int64()) for i, m in enumerate(MEASURES)},
    })


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(block, a, b, n, best): the pairs of each block, with the number of documents that hold them linked in the whole
    corpus and the highest such number of their first id. Summed map-side, so a pair of all blocks is no hot key."""
    asked = blocks.select("block", "pairs", "weights").mapInArrow(_asked, "block string, a int, b int, weight bigint")
    asked = stored(asked, "asked")
    counts = stored(asked.groupBy("a", "b").agg(F.sum("weight").alias("n")), "counts")
    # one row for each id of the first vocabulary
    highest = counts.groupBy("a").agg(F.max("n").alias("best"))
    return asked.join(counts, ["a", "b"]).join(F.broadcast(highest), "a").select("block", "a", "b", "n", "best")


def aligned_blocks(docs: DataFrame, make_left, make_right) -> DataFrame:
    """Distinct texts in blocks, each aligned once: digests, sizes, distinct pairs with their documents, links by text."""
    small_batches(docs.sparkSession, 200)
    distinct = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select(F.sha2("text", 256).alias("sha"), "text", "copies")
    return stored(keyed.mapInArrow(_align(make_left, make_right), _STORE_DDL), "aligned")


def align_tokens(docs: DataFrame, make_left, make_right) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``make_left`` and ``make_right`` build the two tokenizers inside a task. A null or empty text, or one that either side
    can't spell byte for byte, has zeros and an empty digest. Equal texts have equal measures; rows that repeat an id, or
    have none, are rows of their own, and each counts as a document. Other columns are not looked at.
    """
    docs = docs.select("doc_id", filled(F.col("text")).alias("text"))
    blocks = aligned_blocks(docs, make_left, make_right)
    counts = pair_counts(blocks)
    columns = blocks.select("block", "texts", "measures", "digests", "used", "links", "times")
    schema = "sha string, digest string, " + ", ".join(f"{m} bigint" for m in MEASURES)
    measures = stored(columns.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_measured, schema), "measures")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    return rows.join(measures, "sha", "left").select(
        "doc_id", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES), F.coalesce("digest", F.lit("")).alias("groups_sha256")
    )
