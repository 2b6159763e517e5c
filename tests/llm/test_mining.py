"""Hard negatives, suffix dedup and token alignment against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from math import floor, inf, isfinite, nan

import public_tokenizers
import sentencepiece
import xxhash
from conftest import SMALL
from tokenizers import Tokenizer

from wayfolio.llm import hard_negatives, suffix_dedup, token_alignment
from wayfolio.llm.common import table
from samples import messy, messy_rows, nothing, sentence  # noqa: F401


def plain_negatives(rows, relabel):
    own = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not isfinite(x) for x in vector):
            continue
        entry = ((label + 1) % 10 if i % relabel == 0 else label, [floor(256 * x) for x in vector], label)
        own[i] = min(own.get(i, entry), entry, key=lambda e: (e[2], e[1]))
    out = []
    for a, (label, q, _) in own.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, (other, v, _) in own.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus]
            out += [(a, p, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(inside[:10])]
    return sorted(out)


def vectors(n, seed=1):
    draw = random.Random(seed)
    rows = [(i, [draw.choice((-0.5, 0.1, 0.25, 0.6, 1.0)) for _ in range(6)], draw.randrange(3)) for i in range(n)]
    rows += [(i, list(rows[3][1]), 1) for i in range(n, n + n // 2)]  # one very common vector, so many ties
    return rows


def test_hard_negatives(spark):
    odd = [
        (None, [1.0] * 6, 1), (5000, None, 1), (5001, [1.0] * 6, None), (5002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5100, [nan] * 6, 1),
        (5003, [inf] * 6, 1), (5004, [], 1), (5005, [2.0], 2), (5200, [0.0] * 6, 9), (5300, [-1.0] * 6, 0), (100, [1.0] * 6, 1),
        (5006, [0.5] * 9, 1), (5007, [1e6] * 6, 2), (-100, [0.7] * 6, 1), (5400, [1e-30] * 6, 77),
    ]
    given = vectors(900) + odd + vectors(20)
    df = spark.createDataFrame(given, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as q", "2 as g", "3 as a", "4 as own")
    got = hard_negatives.hard_negatives(df.repartition(3), relabel=7).collect()
    want = plain_negatives(given, 7)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == want
    assert len(want) > 300


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    given = vectors(700, seed=4)
    df = spark.createDataFrame(given, "vec_id bigint, embedding array<float>, label int")
    monkeypatch.setattr(hard_negatives, "ROWS", 150)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rounded = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = hard_negatives.hard_negatives(df, relabel=7).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == plain_negatives(rounded, 7)
    assert hard_negatives.hard_negatives(df.filter("false")).collect() == []


def plain_cuts(rows, length=100):
    """{(id, text): result}, in the order of ids, then of the texts' hashes where an id repeats."""
    docs = {(d, t or "") for d, t in rows}
    several = len({d for d, _ in docs}) < len(rows)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0], signed(xxhash.xxh64_intdigest(r[1].encode(), 42)) if several else 0))
    seen, out = set(), {}
    for d, text in order:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(raw[i:i + length])
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out[d, text] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def cut_rows(df):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.orderBy("doc_id", "kept_sha256").collect()]


def test_suffix_dedup_on_messy_rows(messy, nothing):
    got = suffix_dedup.suffix_dedup(messy)
    want = plain_cuts([(d, t) for d, t, *_ in messy_rows()])
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(
        (d or -1, *want[d, t or ""]) for d, t, *_ in messy_rows()
    )
    assert suffix_dedup.suffix_dedup(nothing).collect() == []


def test_suffix_dedup_at_edges(spark):
    draw = random.Random(3)
    noise = "".join(draw.choice("abcdefghij klmnop") for _ in range(400_000))
    passage = noise[1000:1100]
    rows = [
        (1, noise[:300_000]), (2, passage), (3, passage[:99]), (4, "x" + passage), (5, passage + passage[:50]), (6, "z" * 1000),
        (7, noise[150_000:150_250] + "#" + noise[299_950:300_060]), (8, noise[299_901:300_100]), (9, ("z" * 99 + "é") * 3), (10, noise[131_000:131_300]),
        (11, noise[350_000:350_120] * 3), (12, noise[350_050:350_170]), (13, "z" * 300_000), (14, (noise[5:25] * 20)[:300]), (15, noise[5:25] * 30),
        (16, noise[2000:2090] + "Q" + noise[2091:2300]), (17, noise[2000:2090] + "R" + noise[2091:2300]), (18, passage[50:] + passage),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    want = plain_cuts(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {d: want[d, t] for d, t in rows}
    assert got[2][1:3] == (100, 1) and got[3][1] == 0 and got[7][2] == 1
    short = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df, length=40).collect()}
    assert short == {d: v[1] for (d, _), v in plain_cuts(rows, 40).items()}


def test_suffix_dedup_on_the_table(spark):
    docs = table(spark, SMALL, "documents")
    want = plain_cuts([(r.doc_id, r.text) for r in docs.collect()])
    assert cut_rows(suffix_dedup.suffix_dedup(docs)) == [v for _, v in sorted(((d, v[3]), v) for (d, _), v in want.items())]


BYTE_LEVEL, RANKS, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def plain_groups(text, left, right):
    if not text:
        return []
    raw = b" " + text.encode()
    a = [(i, token_alignment.byte_level_bytes(left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in right.encode(text):
        piece = right.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    groups, own, i, j, at, to = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at <= to and i < len(a):
            own[0].append(a[i][0])
            at, i = at + len(a[i][1]), i + 1
        else:
            own[1].append(b[j][0])
            to, j = to + len(b[j][1]), j + 1
        if at == to:
            groups.append(own)
            own = ([], [])
    return groups


def plain_alignment(rows):
    left, right = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    left.encode_special_tokens = True
    groups = {t: plain_groups(t, left, right) for _, t in rows}
    links = {t: [(x, y) for a, b in g for x in a for y in b] for t, g in groups.items()}
    counts = Counter(pair for _, t in rows for pair in set(links[t]))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, t in rows:
        g, own = groups[t], links[t]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            -1 if d is None else d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own),
            sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out)


def aligned(df, ranks=True):
    made = token_alignment.align_tokens(
        df, lambda: token_alignment.ByteLevel(BYTE_LEVEL, RANKS if ranks else None, public_tokenizers.PATTERN), lambda: token_alignment.Pieces(PIECES)
    )
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in made.collect()
    )


AWKWARD = [
    "<|endoftext|> and </s> <s> <unk> <0x41>", "▁ already there", " leading", "trailing ", "a  b   c\t\n\n d", "漢字かな交じり文 и кириллица",
    "\U0001F600\U0001F468‍\U0001F469 flags \U0001F1E9\U0001F1EA", "\x00\x01 control \x7f", "x́ combining é", "12345678901234567890", "ﬁ ligature ½",
    "﻿mark", "…" * 40, "word" * 500, "\r\nlines\r\n", "a" * 5000, " ", "\n", "  ",
]


def test_token_alignment(spark, messy, nothing):
    rows = [(d, t) for d, t, *_ in messy_rows()] + [(1000 + i, t) for i, t in enumerate(AWKWARD)]
    df = messy.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string"), allowMissingColumns=True)
    want = plain_alignment(rows)
    assert aligned(df) == want
    assert aligned(df, ranks=False) == want
    assert aligned(nothing) == []
    zeros = {r[0] for r in want if not r[1]}
    assert {4, 5, 1001} <= zeros and 1000 not in zeros


def test_token_alignment_on_the_table(spark):
    docs = table(spark, SMALL, "documents")
    assert aligned(docs) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_are_folded():
    """A group of very many tokens on both sides has its links counted by id, without making each."""
    class Fixed(token_alignment.Aligned):
        def __init__(self, a, b):
            import numpy as np
            self.a, self.b, self.to_a, self.to_b = a, b, np.array([2, len(a)]), np.array([1, len(b)])

    import numpy as np
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 50, 1500), draw.integers(0, 40, 1400)
    pairs, times = Fixed(a, b).links()
    want = Counter({}) + Counter((int(x), int(b[0])) for x in a[:2])
    for x, n in Counter(a[2:].tolist()).items():
        for y, m in Counter(b[1:].tolist()).items():
            want[x, y] += n * m
    assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pairs, times, strict=True)} == dict(want)


def test_long_texts(spark):
    long = sentence("very long", 150_000)
    word = "ab1" * 400_000
    rows = [(1, long), (2, word), (3, long[:2000]), (4, word[5:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()} == {
        d: v for (d, _), v in plain_cuts(rows).items()
    }
    assert aligned(df) == plain_alignment(rows)
