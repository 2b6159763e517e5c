"""Token ids as Re-Pair grammars: documents in id order, blocks that decode on their own, files that Spark reads back."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfolio.llm.common import scratch_path, small_batches, stored
from wayfolio.llm.kernels import text_bytes
from wayfolio.llm.repair import SEPARATOR, Grammar, compress

END = 1
#: Bytes of text in one file, and ids in one block.
SHARD_BYTES, BLOCK_IDS = 32 << 20, 4 << 20
#: Words a worker remembers the ids of; the memory is emptied when full.
REMEMBERED = 1 << 20

_FILE = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_symbols", pa.binary()), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()),
])
FILE_DDL = (
    "shard int, block int, n_ids bigint, doc_ids array<bigint>, doc_symbols binary, symbols binary, rules binary, lengths binary"
)


_OTHER, _SPACE, _ALNUM, _SIGN = range(4)
_KINDS = bytearray(256)
for _kind, _bytes in (
    (_SPACE, [0x20, *range(0x09, 0x0E)]), (_ALNUM, [*range(0x30, 0x3A), *range(0x61, 0x7B)]),
    (_SIGN, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]),
):
    for _byte in _bytes:
        _KINDS[_byte] = _kind


def _listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """Words without white space as a list; a split is faster than one object at a time."""
    if not len(words):
        return []
    _, offsets, letters = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[:len(words) + 1]
    return np.insert(np.frombuffer(letters, np.uint8)[:bounds[-1]], bounds[1:-1], 0x20).tobytes().split()


class WordEncoder:
    """Ids of texts by the ``tokenizers`` library, each distinct word once.

    For a tokenizer that lower-cases, drops white space and ends a run of letters before a sign, so that a text's ids are
    those of its words in order; ``exact_by_words`` looks at a text to see whether that holds. A word is what ASCII white
    space parts, and a letter or digit from a following sign: fewer of them are distinct than with their signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a run of letters.
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words but the mark behind a text, which is word 0 and the id SEPARATOR."""
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.full(1 << 16, SEPARATOR, np.uint32), 1
        self.begin, self.size, self.words = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64), 1

    def exact_by_words(self, text: str) -> bool:
        return self.tokenizer.encode(text, add_special_tokens=False).ids == self.encode([text.encode()])[0][:-1].tolist()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        for a in range(0, len(plain), 4096):
            own = plain[a:a + 4096]
            ids = np.array(self._ids([" ".join(texts[i] for i in own)])[0], np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):  # each run of letters has one end
                self._remember([words[i] for i in own], ids, np.diff(ends, prepend=0))
            else:
                self._learn_alone([words[i] for i in own])
        left = set(plain)
        self._learn_alone([w for i, w in enumerate(words) if i not in left])

    def _learn_alone(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 20_000):
            found = self._ids([w.decode() for w in words[a:a + 20_000]])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._remember(words[a:a + 20_000], np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes)

    def _remember(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        k = self.words
        while k + len(words) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used:self.used + len(ids)] = ids
        ends = np.cumsum(sizes)
        self.begin[k:k + len(words)], self.size[k:k + len(words)] = self.used + ends - sizes, sizes
        self.known.update(zip(words, range(k, k + len(words)), strict=True))
        self.used, self.words = self.used + len(ids), k + len(words)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, with SEPARATOR behind it."""
        if not texts:
            return []
        if self.words > REMEMBERED:
            self.clear()
        data = b" ".join([*texts, b""])
        special = b"<|" in data  # special tokens are read as they are written
        if not special:
            data = data.lower()
        raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
        inside = kind != _SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] if special else ~inside[:-1] | ((kind[1:] == _SIGN) & (kind[:-1] == _ALNUM))
        starts = np.flatnonzero(begins)
        before = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        offsets = np.append(np.cumsum(inside, dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[starts] - 1, inside.sum()).astype(np.int64)
        letters = pa.py_buffer(raw[inside])
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        words = _listed(coded.dictionary)  # each distinct word of the batch is looked up once
        known = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            self._learn([words[i] for i in missing])
            known[missing] = [self.known[words[i]] for i in missing]
        at = np.insert(known[coded.indices.to_numpy()], before, 0)
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[at] - (ends - size), size) + np.arange(ends[-1])]
        return np.split(ids, ends[at == 0])[:-1]


_encoders: dict[str, WordEncoder] = {}


def _packed(symbols: np.ndarray) -> bytes:
    """Three bytes a symbol, low byte first."""
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.reshape(-1).view("<u4")


def plain_ids(expanded: np.ndarray) -> np.ndarray:
    """Expanded symbols as ids: END (which may be a word's id, too) for each document's end."""
    return np.where(expanded == SEPARATOR, END, expanded).astype("<u4")


def read_block(row: dict) -> Grammar:
    return Grammar(_unpacked(row["symbols"]), _unpacked(row["rules"]).reshape(-1, 2), np.frombuffer(row["lengths"], "<i8"))


def _block(shard: int, number: int, ids: list, documents: list[np.ndarray]) -> pa.RecordBatch:
    grammar = compress(np.concatenate(documents))
    ends = np.flatnonzero(grammar.symbols == SEPARATOR) + 1
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((
        shard, number, sum(map(len, documents)), ids, np.diff(ends, prepend=0).astype("<u4").tobytes(), _packed(grammar.symbols),
        _packed(grammar.rules.ravel()), grammar.lengths.astype("<i8").tobytes(),
    ), _FILE, strict=True)], schema=_FILE)


def _encode(path: str):
    """Maps sorted batches (shard, doc_id, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        shard, number, ids, documents, held = None, 0, [], [], 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            data = raw.tobytes()
            found = encoder.encode([data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            shards, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own, name, tokens in zip(shards, names, found, strict=True):
                if documents and (own != shard or held >= BLOCK_IDS):
                    yield _block(shard, number, ids, documents)
                    number, ids, documents, held = number + 1, [], [], 0
                if own != shard:
                    shard, number = own, 0
                ids.append(name)
                documents.append(tokens)
                held += len(tokens)
        if documents:
            yield _block(shard, number, ids, documents)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, identity: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts to the folder ``path``, a Parquet table with a row per block (FILE_DDL).

    Documents are in ascending order of (id, text hash), null ids first; a shard is a range of them. Each ends with
    END. A block is a grammar of whole documents: ``doc_symbols`` (u4) says how many symbols each has, symbols and rules take three
    bytes each, ``lengths`` (i8) are the rules' expansions, by which any position is found without decoding what precedes.

    * A null text is empty: its END alone. Long texts are encoded whole. Other columns are not read.
    * Rows that repeat an id are documents of their own. An empty table gives an empty folder with the schema.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(_encode(tokenizer), FILE_DDL).write.parquet(path)


def with_starts(blocks: DataFrame) -> DataFrame:
    """Blocks with ``start``, the ids of all documents before them: sums per shard, prefix sums over those, then inside."""
    sizes = stored(blocks.select("shard", "block", "n_ids"), "sizes")
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "shard")
    return blocks.join(stored(placed.select("shard", "block", (F.col("before") + F.col("inside")).alias("start")), "block_starts"), ["shard", "block"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_DDL).parquet(path)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def token_digests(blocks: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian u4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = read_block(row)
                symbols = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
                lengths = np.concatenate([[0], np.cumsum(grammar.sizes(grammar.symbols))])
                bounds = lengths[np.concatenate([[0], np.cumsum(symbols)])]
                data = memoryview(plain_ids(grammar.expand(grammar.symbols)).tobytes())
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
                ], schema=_DIGEST)

    ready = with_starts(blocks).select("start", "doc_ids", "doc_symbols", "symbols", "rules", "lengths")
    return ready.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def scratch_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The files of ``docs`` written to a fresh folder of the shared place, and read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
