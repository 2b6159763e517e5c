"""Language-model scores: word counts of the whole corpus joined with a hashed maximum-entropy model of word classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfolio.llm.common import random_key, small_batches, stored
from wayfolio.llm.lm_model import CLASSES, END_HASH, OWN, Classes, MaxEnt, Tokens, group_classes

#: Rounds of training, which share the training texts among them, and bytes of text per task.
#: A task's weights have a fixed size, so what a round gathers is in proportion to the text.
ROUNDS, TASK_BYTES = 4, 64 << 20
#: Bytes of text, and texts, whose words are one block on the sending side, and bytes whose words meet in one reducer.
BLOCK_BYTES, BLOCK_TEXTS, BUCKET_BYTES = 16 << 20, 60_000, 16 << 20
_WEIGHT_ROWS = 512


@dataclass
class Model:
    classes: Classes
    weights: MaxEnt


# --- learning ----------------------------------------------------------------------------------------------


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = Classes(np.zeros(0, np.uint64))
    for batch in batches:
        words, n = np.unique(classes.tokens(batch.column(0)).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _class_pairs(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for batch in batches:
            tokens = classes.tokens(batch.column(0))
            before = np.full(len(tokens.classes), CLASSES)
            before[1:] = tokens.classes[:-1]
            before[tokens.bounds[:-1]] = CLASSES
            pairs += np.bincount(before * CLASSES + tokens.classes, minlength=len(pairs))
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs[at])], ["pair", "n"])

    return run


def _descend(model: Model):
    """Maps texts to the weights after AdaGrad steps over all of them, cut into slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = model.weights, 0
        state = (np.zeros_like(weights.wide), np.zeros_like(weights.deep))
        for batch in batches:
            tokens = model.classes.tokens(batch.column(0))
            weights.learn(tokens, state)
            seen += len(tokens.classes)
        if seen:
            for kind, rows in enumerate((weights.wide, weights.deep)):
                for a in range(0, len(rows), _WEIGHT_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([a], pa.int32()), pa.array([seen], pa.int64()),
                                                      pa.array([rows[a:a + _WEIGHT_ROWS].tobytes()], pa.binary())],
                                                     ["kind", "first", "seen", "weights"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    """The mean of one slice's weights over tasks, by the tokens each has seen."""
    seen = table["seen"].to_numpy().astype(float)
    rows = [np.frombuffer(x, np.float32) for x in table["weights"].to_pylist()]
    mean = sum(r * (s / seen.sum()) for r, s in zip(rows, seen, strict=True)).astype(np.float32)
    return pa.table({"kind": table["kind"][:1], "first": table["first"][:1], "weights": pa.array([mean.tobytes()], pa.binary())})


def learn_model(train: DataFrame) -> Model:
    """The model from the training rows (doc_id, text, bytes known by the caller's scan).

    Words are counted and classes paired where the texts are, over all of them; the driver gets the OWN most frequent words
    and the table of class pairs. Then ROUNDS rounds of distributed gradient updates, each over its part of the texts, so that
    every text is stepped through once: every task starts from the same weights and steps through its own texts, and the
    tasks' weights are averaged by slices. Sizes that reach the driver are fixed.
    """
    spark = train.sparkSession
    key = random_key(F.col("doc_id"))
    volume = train.agg(F.sum(F.octet_length("text"))).first()[0]
    texts = train.select("text")
    counts = texts.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("word") != int(END_HASH.view(np.int64))).orderBy(F.desc("n"), "word").limit(OWN - 1).toPandas()
    frequent = top["word"].to_numpy(np.int64).view(np.uint64)

    found = texts.mapInArrow(_class_pairs(Classes(frequent)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((CLASSES + 1) * CLASSES)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"]
    pairs = pairs.reshape(CLASSES + 1, CLASSES)
    place = group_classes(pairs)
    moved = np.zeros_like(pairs)
    moved[np.ix_(np.append(place, CLASSES), place)] = pairs
    possible = np.zeros(CLASSES, bool)
    possible[place[:1 + len(frequent)]] = possible[place[OWN:]] = True
    model = Model(Classes(frequent, place), MaxEnt(moved.sum(0), moved, possible))

    tasks = max(1, -(-int(volume or 0) // (ROUNDS * TASK_BYTES)))
    cell = F.pmod(F.floor(key / 1024), F.lit(ROUNDS))
    for round_ in range(ROUNDS):
        own = train.filter(cell == round_).select("text")
        tasks_now = max(tasks, min(own.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
        steps = own.coalesce(tasks_now).mapInArrow(_descend(model), "kind int, first int, seen bigint, weights binary")
        mean = steps.groupBy("kind", "first").applyInArrow(_mean, "kind int, first int, weights binary").collect()
        for row in mean:
            rows = (model.weights.wide, model.weights.deep)[row["kind"]]
            part = np.frombuffer(row["weights"], np.float32).reshape(-1, rows.shape[1])
            rows[row["first"]:row["first"] + len(part)] = part
    return model


# --- counting and scoring ----------------------------------------------------------------------------------

_BLOCK = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("classes", pa.binary()), ("trained", pa.binary()),
    ("pairs", pa.binary()), ("texts", pa.binary()), ("times", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("class_scores", pa.list_(pa.float64())),
])
_BLOCK_DDL = (
    "block bigint, bucket int, hashes binary, classes binary, trained binary, pairs binary, texts binary, times binary, counts binary, "
    "doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, class_scores array<double>"
)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in _BLOCK], schema=_BLOCK)


def _blocks(model: Model, buckets: int):
    """Maps batches (doc_id, held_out, text) to blocks: a row with the texts' class scores, and a row per bucket of words.

    Of each distinct word of the block: its hash, its class, its count in training texts, in how many texts it is, in
    which (u2) and how often (u1). A word is sent once per block, however many texts hold it.
    """
    width = np.uint64((1 << 64) // buckets) if buckets > 1 else np.uint64((1 << 64) - 1)

    def close(block: int, ids: list, held: list, parts: list[Tokens], scores: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, classes = (np.concatenate([getattr(p, x) for p in parts]) for x in ("hashes", "classes"))
        sizes = np.concatenate([np.diff(p.bounds) for p in parts])
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(np.concatenate(scores))])
        yield _row(block=block, doc_ids=ids, held=held, sizes=sizes.tolist(), class_scores=(sums[ends] - sums[ends - sizes]).tolist())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(hashes, kind="stable")  # texts stay in order within a word
        hashes, classes, owner = hashes[order], classes[order], owner[order]
        word = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        pair = word | np.concatenate([[True], owner[1:] != owner[:-1]])
        at = np.flatnonzero(pair)
        times = np.diff(np.append(at, len(owner)))
        wide = -(-times // 255)  # more than 255 times are several entries
        text = np.repeat(owner[at], wide)
        last = np.cumsum(wide) - 1
        count = np.full(len(text), 255)
        count[last] = times - 255 * (wide - 1)
        starts = np.flatnonzero(word)
        trained = np.add.reduceat(np.where(np.array(held, bool)[owner], 0, 1), starts)
        first = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(at, starts)]
        pairs = np.diff(np.append(first, len(text)))
        bucket = np.minimum(hashes[starts] // width, np.uint64(buckets - 1)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            a, z = cuts[b], cuts[b + 1]
            p, q = first[a], first[z] if z < len(first) else len(text)
            yield _row(
                block=block, bucket=int(b), hashes=hashes[starts[a:z]].tobytes(), classes=classes[starts[a:z]].astype("<u2").tobytes(),
                trained=trained[a:z].astype("<u4").tobytes(), pairs=pairs[a:z].astype("<u4").tobytes(),
                texts=text[p:q].astype("<u2").tobytes(), times=count[p:q].astype(np.uint8).tobytes(),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, parts, scores, volume = TaskContext.get().partitionId() << 32, [], [], [], [], 0
        for batch in batches:
            tokens = model.classes.tokens(batch.column(2))
            parts.append(tokens)
            scores.append(model.weights.log10_classes(tokens))
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            volume += 8 * len(tokens.hashes)
            if volume >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                yield from close(block, ids, held, parts, scores)
                block, ids, held, parts, scores, volume = block + 1, [], [], [], [], 0
        if ids:
            yield from close(block, ids, held, parts, scores)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block the whole corpus's count of its words, and per class the known words and their count."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    trained = np.concatenate([np.frombuffer(x, "<u4") for x in table["trained"].to_pylist()]).astype(np.int64)
    classes = np.concatenate([np.frombuffer(x, "<u2") for x in table["classes"].to_pylist()]).astype(np.int64)
    cuts = np.cumsum([len(h) for h in hashes])
    words, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, which, trained)
    known = counts > 0
    types = np.bincount(classes[first[known]], minlength=CLASSES)
    mass = np.bincount(classes[first[known]], weights=counts[known], minlength=CLASSES).astype(np.int64)
    n = table.num_rows
    own = np.flatnonzero(types)
    return pa.table({
        "block": pa.concat_arrays([table["block"].combine_chunks(), pa.nulls(len(own), pa.int64())]),
        "bucket": pa.concat_arrays([table["bucket"].combine_chunks(), pa.nulls(len(own), pa.int32())]),
        "counts": pa.array([c.astype("<i8").tobytes() for c in np.split(counts[which], cuts[:-1])] + [None] * len(own), pa.binary()),
        "class": pa.array([None] * n + own.tolist(), pa.int32()), "types": pa.array([None] * n + types[own].tolist(), pa.int64()),
        "mass": pa.array([None] * n + mass[own].tolist(), pa.int64()),
    })


_SCORES_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(train_tokens: int, train_words: int, class_mass: np.ndarray):
    """Maps one block's rows to its texts' scores."""
    floor = np.log10(train_tokens + 0.5 * (train_words + 1))
    log_mass = np.log10(class_mass)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts = next(r for r in rows if r["doc_ids"] is not None)
        n = len(texts["doc_ids"])
        counts = {r["bucket"]: np.frombuffer(r["counts"], "<i8") for r in rows if r["counts"] is not None}
        inside, known, share = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in rows:
            if r["hashes"] is None:
                continue
            count, pairs = counts[r["bucket"]], np.frombuffer(r["pairs"], "<u4")
            owner, times = np.frombuffer(r["texts"], "<u2"), np.frombuffer(r["times"], np.uint8).astype(float)
            own = np.log10(count + 0.5)
            inside += np.bincount(owner, weights=times * np.repeat(own, pairs), minlength=n)
            known += np.bincount(owner, weights=times * np.repeat(count > 0, pairs), minlength=n)
            share += np.bincount(owner, weights=times * np.repeat(log_mass[np.frombuffer(r["classes"], "<u2")], pairs), minlength=n)
        sizes = np.array(texts["sizes"])
        return pa.table({
            "doc_id": pa.array(texts["doc_ids"], pa.int64()), "held_out": pa.array(texts["held"], pa.bool_()), "n_tokens": pa.array(sizes, pa.int64()),
            "n_known": pa.array(known.round().astype(np.int64)), "train_tokens": pa.array([train_tokens] * n, pa.int64()),
            "base_score": inside - sizes * floor, "score": np.array(texts["class_scores"]) + inside - share,
        })

    return run


def lm_scores(docs: DataFrame, held_out: Column, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (split at ASCII white space, A-Z lower-cased) and one end per text. ``base_score`` is the unigram
    model with half a count added, ``score`` the log10 probability under P(class | context) P(word | class). The context
    model is maximum entropy over hashed n-gram and skip features; within a class words have their smoothed frequency. Both
    learn only from rows where ``held_out`` is false. An unknown word is one further word of its class, so the
    probabilities of all words and of an unknown one in each class of endings sum to 1.

    Counts are of the whole corpus, however many words it has: each block of texts sends its distinct words to buckets of
    hashes, the buckets send the counts back, and a block's rows meet again by the block. No word's rows and no vocabulary
    come together in one task, and nothing grows with the input on the driver. Words are identified by 64 bits of hash.

    * A null text is empty: one token, its end. A null id is kept. Rows that repeat an id are scored each.
    * Without training rows all counts are 0. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(identity).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = learn_model(rows.filter(~F.col("held_out")).select("doc_id", "text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(volume) // BUCKET_BYTES))
    sent = spark.sparkContext.broadcast(model)
    blocks = stored(rows.mapInArrow(lambda batches: _blocks(sent.value, buckets)(batches), _BLOCK_DDL), "lm_blocks")

    words = blocks.filter("bucket is not null").select("block", "bucket", "hashes", "classes", "trained")
    counted = stored(words.groupBy("bucket").applyInArrow(
        _counted, "block bigint, bucket int, counts binary, class int, types bigint, mass bigint"), "lm_counts")
    of_class = counted.filter("class is not null").groupBy("class").agg(F.sum("types").alias("types"), F.sum("mass").alias("mass")).collect()
    total, types = sum(r["mass"] for r in of_class), sum(r["types"] for r in of_class)
    mass = np.zeros(CLASSES)
    for r in of_class:
        mass[r["class"]] = r["mass"] + 0.5 * r["types"]
    mass[model.classes.place[OWN:]] += 0.5  # the unknown word
    mass = np.maximum(mass, 0.5)

    replies = counted.filter("block is not null").select("block", "bucket", "counts")
    slim = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in ("trained", "counts") else F.col(f.name) for f in blocks.schema]
    slim = [F.when(F.col("hashes").isNotNull(), F.lit(b"")).alias("hashes") if f.name == "hashes" else c for f, c in zip(blocks.schema, slim, strict=True)]
    return blocks.select(*slim).unionByName(replies, allowMissingColumns=True).groupBy("block").applyInArrow(
        _scored(total, types, mass), _SCORES_DDL)
