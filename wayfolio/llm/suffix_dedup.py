"""Removal of byte strings that also start earlier in the corpus, by bucket-pointer refinement.

Every suffix has a bucket pointer: a name of its first bytes. Names of 8 bytes are the bytes themselves; a longer name is made
of the names at an offset and at a later one (8, 16, 32, 64 bytes, then the whole string), each level reusing the one before.

The corpus-wide buckets start with 32-byte grams, at sampled suffixes only: the smallest gram of every string of ``length``
bytes, which equal strings share. A run of strings with one sampled suffix is one member of its bucket. Buckets are refined
by sorting their members on the names at later offsets. A member that equals an earlier one is settled as a whole, a member
alone in its bucket is settled too, and only members that differ in part are refined once more, string by string.

Names are 64-bit, and compared inside a bucket, which is itself known by a 64-bit name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfolio.llm.common import filled, small_batches, stored
from wayfolio.llm.kernels import mix, text_bytes

LENGTH = 100
GRAM = 32
#: Bytes of text whose members a task compares before it sends them on, and bytes a bucket range stands for.
BLOCK_BYTES = 16 << 20
#: Names are made for so many suffixes at a time.
PIECE = 1 << 17
#: Null ids come first.
NO_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(mix(x + _ODD) + y * _ODD)


class _Names:
    """Bucket pointers of the suffixes of one piece; ``windows`` of them have ``length`` bytes left."""

    def __init__(self, raw: np.ndarray, length: int):
        whole = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(raw) - 7,), "<u8", whole, strides=(1,)).astype(np.uint64)
        sixteen = _pair(eight[:-8], eight[8:])
        self.grams = _pair(sixteen[:-16], sixteen[16:])
        self.windows = len(raw) - length + 1

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        """Names of ``size`` bytes: those of the largest power of two below it, at the front and at the end."""
        if size == GRAM:
            return self.grams[at]
        half = 1 << ((size - 1).bit_length() - 1)
        return _pair(self.of(at, half), self.of(at + (size - half), half))

    def sampled(self, length: int) -> np.ndarray:
        """For each window the place of its smallest gram, the leftmost of equal ones."""
        places = np.uint64((1 << 20) - 1)
        low = (self.grams & ~places) | np.arange(len(self.grams), dtype=np.uint64)
        width, span = length - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        return (low & places).astype(np.int64)


def _pieces(raw: np.ndarray, length: int) -> Iterator[tuple[int, _Names]]:
    for base in range(0, len(raw) - length + 1, PIECE):
        yield base, _Names(raw[base:base + PIECE + length - 1], length)


def members(raw: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """[text number, first window in the text, number of windows, bucket, name] of the runs of windows that share a sample."""
    found = []
    sizes = np.diff(offsets)
    inside = np.zeros(len(raw) + 1, np.int8)
    long_enough = sizes >= length
    np.add.at(inside, offsets[:-1][long_enough], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[long_enough], -1)
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    for base, names in _pieces(raw, length):
        ok = inside[base:base + names.windows]
        if not ok.any():
            continue
        place = names.sampled(length)
        text_start = np.zeros(names.windows, bool)
        begins = offsets[:-1][long_enough] - base
        text_start[begins[(begins >= 0) & (begins < names.windows)]] = True
        changed = np.concatenate([[True], (place[1:] != place[:-1]) | ~ok[:-1]]) | text_start
        first = np.flatnonzero(changed & ok)
        closes = np.concatenate([(changed | ~ok)[1:], [True]])
        last = np.flatnonzero(closes & ok)
        at = place[first]
        n = last - first + 1
        bounds = ((at - first).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        name = _pair(_pair(names.of(first, length), names.of(last, length)), bounds)
        text = np.searchsorted(offsets, first + base, side="right") - 1
        found.append((text, first + base - offsets[text], n, names.grams[at], name))
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.uint64 if i > 2 else np.int64) for i in range(5)]


def _packed(columns: list[np.ndarray]) -> bytes:
    planes = b"".join(np.ascontiguousarray(c.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def merged(ids: np.ndarray, marks: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window ranges of documents, joined where they touch or overlap."""
    order = np.lexsort((start, marks, ids))
    ids, marks, start, end = ids[order], marks[order], start[order], (start + n)[order]
    if not len(ids):
        return ids, marks, start, end
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    group = np.cumsum(fresh) - 1
    # the furthest end so far within each document: documents are lifted above one another
    lift = group * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift) - lift
    cut = fresh | np.concatenate([[True], start[1:] > far[:-1]])
    first = np.flatnonzero(cut)
    return ids[first], marks[first], start[first], far[np.append(first[1:], len(ids)) - 1] - start[first]


class _Members:
    """Members of buckets: [bucket, name, id, mark, first window, windows], settled among themselves."""

    COLUMNS = 6

    def __init__(self, columns: list[np.ndarray]):
        bucket, name, ids, marks, start, n = (c.astype(np.int64, copy=False) for c in columns)
        order = np.lexsort((start, marks, ids, name, bucket))
        columns = [c[order] for c in (bucket, name, ids, marks, start, n)]
        differs = [np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool) for c in columns[:5]]
        self.head = differs[0] | differs[1]
        once = self.head | differs[2] | differs[3] | differs[4]  # a row given twice is one document
        self.columns = [c[once] for c in columns]
        self.head = self.head[once]

    def repeated(self) -> tuple[np.ndarray, ...]:
        """Window ranges (id, mark, first, number) that an earlier equal member covers."""
        return merged(*(c[~self.head] for c in self.columns[2:]))

    def first(self) -> list[np.ndarray]:
        return [c[self.head] for c in self.columns]

    def apart(self) -> list[np.ndarray]:
        """Distinct members of buckets that hold more than one."""
        bucket, *rest = self.first()
        same = bucket[1:] == bucket[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(bucket) else np.zeros(0, bool)
        return [c[more] for c in (bucket, *rest)]


_SENT = "bucket bigint, kind int, data binary"


def _send(found: _Members, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for each bucket range: its members (kind 0); what is settled already goes along with any (kind 1)."""
    own = found.first()
    target = (own[0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    bounds = np.flatnonzero(np.diff(target[order], prepend=-1))
    out = [(int(target[order[a]]), 0, _packed([c[order[a:b]] for c in own])) for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True)]
    settled = found.repeated()
    if len(settled[0]):
        out.append((int(settled[0][0]) % buckets, 1, _packed(list(settled))))
    for a in range(0, len(out), 64):
        part = out[a:a + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.binary())],
            names=["bucket", "kind", "data"],
        )


class _Collector:
    """Members of a block of text."""

    def __init__(self, buckets: int):
        self.buckets, self.found, self.weight = buckets, [], 0

    def add(self, columns: list[np.ndarray], weight: int) -> Iterator[pa.RecordBatch]:
        self.found.append(columns)
        self.weight += weight
        if self.weight >= BLOCK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            columns = [np.concatenate([f[i] for f in self.found]) for i in range(_Members.COLUMNS)]
            self.found, self.weight = [], 0
            if len(columns[0]):
                yield from _send(_Members(columns), self.buckets)


def _members_of(length: int, buckets: int):
    """(key, mark, text) to members by bucket range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Collector(buckets)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            text, start, n, bucket, name = members(raw, offsets, length)
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("key", "mark"))
            yield from block.add([bucket.view(np.int64), name.view(np.int64), ids, marks, start, n], len(raw))
        yield from block.flush()

    return run


def _strings_of(length: int, buckets: int):
    """(key, mark, text, apart) to single strings by bucket range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Collector(buckets)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            lists = batch.column("apart")
            count = np.diff(lists.offsets.to_numpy())
            entries = lists.flatten()
            place, bucket = (entries.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            text = np.repeat(np.arange(batch.num_rows), count)
            start, n = place >> 32, place & 0xFFFFFFFF
            first = np.repeat(offsets[text] + start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            text, bucket = np.repeat(text, n), np.repeat(bucket, n)
            order = np.argsort(first, kind="stable")
            first, text, bucket = first[order], text[order], bucket[order]
            names = np.empty(len(first), np.int64)
            for base, piece in _pieces(raw, length):
                a, b = np.searchsorted(first, (base, base + piece.windows))
                names[a:b] = piece.of(first[a:b] - base, length).view(np.int64)
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("key", "mark"))
            yield from block.add([bucket, names, ids, marks, first - offsets[text], np.ones(len(first), np.int64)], len(raw) + 16 * len(first))
        yield from block.flush()

    return run


def _settle(refine: bool):
    """Members of one bucket range, from all blocks: window ranges that are repeated, and members to be refined."""
    def run(rows: pa.Table) -> pa.Table:
        given = {0: [np.zeros((_Members.COLUMNS, 0), np.int64)], 1: [np.zeros((4, 0), np.int64)]}
        for kind, data in zip(rows["kind"].to_pylist(), rows["data"], strict=True):
            given[kind].append(_unpacked(data.as_py(), 4 if kind else _Members.COLUMNS))
        found = _Members(list(np.concatenate(given[0], axis=1)))
        settled = merged(*(np.concatenate(x) for x in zip(found.repeated(), np.concatenate(given[1], axis=1), strict=True)))
        apart = found.apart() if refine else [np.zeros(0, np.int64)] * _Members.COLUMNS
        keys, marks, start, n = (np.concatenate([s, a]) for s, a in zip(settled, apart[2:], strict=True))
        bucket = pa.array(np.concatenate([np.zeros(len(settled[0]), np.int64), apart[0]]), mask=np.arange(len(keys)) < len(settled[0]))
        return pa.table({"key": keys, "mark": marks, "place": start << 32 | n, "bucket": bucket})

    return run


_SETTLED = "key bigint, mark bigint, place bigint, bucket bigint"


def _cut(length: int):
    """(row columns, text, places) to what is left of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            whole = raw.tobytes()
            lists = batch.column("places").fill_null([]) if batch.column("places").null_count else batch.column("places")
            bounds, places = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = bounds - bounds[0]
            out = []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                own = np.sort(places[bounds[i]:bounds[i + 1]])
                sha = hashlib.sha256()
                start, end = own >> 32, (own >> 32) + (own & 0xFFFFFFFF) + length - 1
                at = removed = spans = 0
                if len(own):
                    far = np.maximum.accumulate(end)
                    cut = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
                    for s, e in zip(start[cut].tolist(), far[np.append(cut[1:], len(own)) - 1].tolist(), strict=True):
                        sha.update(whole[a + at:a + s])
                        at, removed, spans = e, removed + e - s, spans + 1
                sha.update(whole[a + at:b])
                out.append((int(b - a), removed, spans, sha.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_places(docs: DataFrame, keys: list[str], length: int = LENGTH) -> DataFrame:
    """(key, mark, place): ranges of windows (first << 32 | number) whose string also starts earlier. ``docs``: (key, mark, text)."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BLOCK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 16))
    sent = docs.mapInArrow(_members_of(length, buckets), _SENT)
    settled = stored(sent.groupBy("bucket").applyInArrow(_settle(True), _SETTLED), "settled")
    apart = settled.filter("bucket IS NOT NULL").groupBy("key", "mark").agg(F.collect_list(F.struct("place", "bucket")).alias("apart"))
    strings = docs.join(apart.select(*keys, "apart"), keys).mapInArrow(_strings_of(length, buckets), _SENT)
    refined = strings.groupBy("bucket").applyInArrow(_settle(False), _SETTLED)
    return settled.filter("bucket IS NULL").unionAll(refined).select("key", "mark", "place")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``: each byte inside a string of ``length``
    bytes that also starts earlier (in a smaller id, or earlier in the same text) is removed.

    Texts are their UTF-8 bytes, null is empty, and no string crosses documents; strings are judged on the input. A null id
    comes before all others. Rows of one id with different texts follow one another in the order of a hash of their texts;
    rows that repeat id and text are one document, and have the same result. Other columns are not looked at. ``length`` is
    more than 32.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    small_batches(docs.sparkSession, 200)
    text = filled(F.col("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")
    ids = docs.select(key).groupBy("key").count()
    several = not ids.filter("count > 1").isEmpty()
    keys = ["key", "mark"] if several else ["key"]
    rows = docs.select("doc_id", key, (F.xxhash64(text) if several else F.lit(0).cast("long")).alias("mark"), text.alias("text"))
    places = repeated_places(rows, keys, length).groupBy("key", "mark").agg(F.collect_list("place").alias("places"))
    whole = rows.join(places.select(*keys, "places"), keys, "left").select("doc_id", "text", "places")
    id_type = dict(docs.dtypes)["doc_id"]
    return whole.mapInArrow(_cut(length), f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
