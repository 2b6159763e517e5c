"""Hashed maximum-entropy model of the next word's class: n-gram and skip features, class-factored softmax, AdaGrad."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from wayfolio.llm.kernels import _LOWER, mix, text_bytes, word_bounds, word_hashes

#: Classes are numbered group * MEMBERS + member after factoring. Before it: 0 is the end of a text, then come the most
#: frequent words with a class each, then classes of word endings.
GROUPS, MEMBERS = 16, 32
CLASSES, OWN = GROUPS * MEMBERS, 256
#: Rows of the hashed features: pairs of classes and preceding words for groups, pairs of classes for members.
PAIR_ROWS, WORD_ROWS, MEMBER_PAIR_ROWS = 1 << 12, 1 << 13, 1 << 11
BATCH, RATE = 4096, 0.15
#: Feature rows that a batch holds at most so often are summed place by place, the others by runs.
FEW = 4
END_HASH = np.uint64(0x1B873593CC9E2D51)
_START = CLASSES
_CLOSED = np.float32(-1e4)


@dataclass
class Tokens:
    """All tokens of a batch of texts, each text's end included: word hashes, classes, and where each text begins."""

    hashes: np.ndarray
    classes: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


class Classes:
    """A word's class by its text alone: its own if it is one of the frequent words, else that of its last three bytes."""

    def __init__(self, frequent: np.ndarray, place: np.ndarray | None = None):
        """``frequent``: hashes of at most OWN - 1 words, most frequent first. ``place``: class to (group, member) number."""
        order = np.argsort(frequent)
        self.hashes, self.numbers = frequent[order], (order + 1).astype(np.int64)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.place = np.arange(CLASSES) if place is None else place

    def tokens(self, column: pa.Array) -> Tokens:
        raw, offsets = text_bytes(column)
        starts, ends, per_text = word_bounds(raw, offsets)
        words = word_hashes(raw, starts, ends)
        tail = np.zeros(len(words), np.uint64)
        for k in range(3):
            has = ends - starts > k
            tail[has] = (tail[has] << np.uint64(8)) + _LOWER[raw[ends[has] - 1 - k]].astype(np.uint64) + np.uint64(1)
        classes = (mix(tail) % np.uint64(CLASSES - OWN)).astype(np.int64) + OWN
        likely = np.flatnonzero(self.bits[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if len(likely) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words[likely]), len(self.hashes) - 1)
            same = self.hashes[at] == words[likely]
            classes[likely[same]] = self.numbers[at[same]]
        bounds = per_text + np.arange(len(per_text))
        is_end = np.zeros(bounds[-1], bool)
        is_end[bounds[1:] - 1] = True
        hashes, all_classes = np.empty(bounds[-1], np.uint64), np.zeros(bounds[-1], np.int64)
        hashes[is_end], hashes[~is_end], all_classes[~is_end] = END_HASH, words, classes
        return Tokens(hashes, self.place[all_classes], bounds)


def group_classes(pairs: np.ndarray) -> np.ndarray:
    """class to (group, member) number, from the counts of (class before, class): classes in like contexts share a group.

    Halves the classes at the median of the first principal component of their contexts, again and again.
    """
    near = np.concatenate([pairs[:CLASSES].T, pairs[:CLASSES]], axis=1).astype(float)
    expected = near.sum(1, keepdims=True) * near.sum(0, keepdims=True) / max(1.0, near.sum())
    shape = np.log1p(near) - np.log1p(expected)
    parts = [np.arange(CLASSES)]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            own = shape[part] - shape[part].mean(0)
            _, _, axes = np.linalg.svd(own, full_matrices=False)
            order = part[np.argsort(own @ axes[0], kind="stable")]
            halves += [np.sort(order[:len(order) // 2]), np.sort(order[len(order) // 2:])]
        parts = halves
    place = np.empty(CLASSES, np.int64)
    for g, part in enumerate(parts):
        place[part] = g * MEMBERS + np.arange(MEMBERS)
    return place


def row_sums(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ``rows``, sums of their ``values``), each summed as ``np.add.reduceat`` over the sorted rows does.

    ``reduceat`` makes a call per sum and column. Most rows are rare, and these are summed all together. Row numbers below
    2^16 are sorted by radix.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(at, len(order)))
    by_size = np.argsort(np.minimum(size, FEW + 1).astype(np.uint8), kind="stable")
    first, size = at[by_size], size[by_size]
    more = np.searchsorted(np.minimum(size, FEW + 1), np.arange(FEW + 2), side="right")  # where more than k values begin
    few = more[FEW]
    sums = np.take(values, order[first], axis=0, mode="clip")
    rest = np.take(values, order[first[more[1]:few] + 1], axis=0, mode="clip")
    for k in range(2, FEW):
        rest[more[k] - more[1]:] += np.take(values, order[first[more[k]:few] + k], axis=0, mode="clip")
    sums[more[1]:few] += rest
    if few < len(first):
        long = size[few:]
        starts = np.cumsum(long) - long
        places = np.repeat(first[few:] - starts, long) + np.arange(long.sum())
        sums[few:] = np.add.reduceat(np.take(values, order[places], axis=0, mode="clip"), starts, axis=0)
    return ordered[first], sums


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``table[rows] = values``, a row as one item."""
    item = f"V{table.itemsize * table.shape[1]}"
    table.view(item)[:, 0][rows] = values.view(item)[:, 0]


class MaxEnt:
    """Weights of P(class | context) = P(group | context) P(member | group, context).

    ``wide`` rows have a weight per group, ``deep`` rows (feature, group) one per member. Their number is fixed.
    """

    _WIDE = np.cumsum([0, CLASSES + 1, CLASSES + 1, CLASSES + 1, PAIR_ROWS, WORD_ROWS])
    _DEEP = np.cumsum([0, CLASSES + 1, CLASSES + 1, MEMBER_PAIR_ROWS]) * GROUPS

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, possible: np.ndarray):
        """Starts at the smoothed class frequencies ``counts`` and at what the class before (``pairs``) changes in them."""
        base = np.where(possible, counts + 0.5, 0.0).reshape(GROUPS, MEMBERS)
        share = base / base.sum()
        group, member = share.sum(1), share / np.maximum(share.sum(1, keepdims=True), 1e-12)
        self.group_bias = np.log(np.maximum(group, 1e-9)).astype(np.float32)
        self.member_bias = np.where(share > 0, np.log(np.maximum(member, 1e-12)), _CLOSED).astype(np.float32)
        self.wide = np.zeros((self._WIDE[-1], GROUPS), np.float32)
        self.deep = np.zeros((self._DEEP[-1], MEMBERS), np.float32)
        seen = pairs.reshape(CLASSES + 1, GROUPS, MEMBERS).astype(float)
        of_group = seen.sum(2)
        after = (of_group + 20 * group) / (of_group.sum(1, keepdims=True) + 20)
        self.wide[:CLASSES + 1] = np.log(np.maximum(after, 1e-9)) - self.group_bias
        inside = (seen + 20 * member) / (of_group[:, :, None] + 20)
        ratio = np.where(share > 0, np.log(np.maximum(inside, 1e-12)) - np.where(share > 0, self.member_bias, 0), 0)
        self.deep[:self._DEEP[1]] = ratio.reshape(-1, MEMBERS)

    def rows(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``wide`` for each token's context, and of ``deep`` without the group's share."""
        before = []
        for k in range(1, 4):
            back = np.full(len(tokens.classes), _START)
            back[k:] = tokens.classes[:-k] if k < len(back) else back[k:]
            for j in range(k):
                at = tokens.bounds[:-1] + j
                back[at[at < tokens.bounds[1:]]] = _START
            before.append(back)
        word = np.full(len(tokens.hashes), np.uint64(0))
        word[1:] = tokens.hashes[:-1]
        word[tokens.bounds[:-1]] = 0
        pair = mix((before[0] * (CLASSES + 1) + before[1]).astype(np.uint64))
        wide = [before[0], before[1], before[2], (pair % np.uint64(PAIR_ROWS)).astype(np.int64), (word % np.uint64(WORD_ROWS)).astype(np.int64)]
        deep = [before[0], before[1], (pair % np.uint64(MEMBER_PAIR_ROWS)).astype(np.int64)]
        return (np.stack([r + o for r, o in zip(wide, self._WIDE, strict=False)]),
                np.stack([r * GROUPS + o for r, o in zip(deep, self._DEEP, strict=False)]))

    def _forward(self, wide: np.ndarray, deep: np.ndarray, group: np.ndarray):
        over_groups = self.group_bias + np.take(self.wide, wide[0], axis=0, mode="clip")
        for r in wide[1:]:
            over_groups += np.take(self.wide, r, axis=0, mode="clip")
        over_members = np.take(self.member_bias, group, axis=0, mode="clip")
        for r in deep:
            over_members += np.take(self.deep, r + group, axis=0, mode="clip")
        out = []
        for logits in (over_groups, over_members):
            logits -= np.ascontiguousarray(logits.T).max(0)[:, None]  # over columns, the maximum of a few is slow
            odds = np.exp(logits)
            out.append((logits, odds, odds.sum(1)))
        return out

    def log10_classes(self, tokens: Tokens) -> np.ndarray:
        """log10 P(class | context) of every token."""
        out = np.empty(len(tokens.classes))
        wide, deep = self.rows(tokens)
        group, member = np.divmod(tokens.classes, MEMBERS)
        for a in range(0, len(out), BATCH):
            g, m = group[a:a + BATCH], member[a:a + BATCH]
            (lg, _, sg), (lm, _, sm) = self._forward(wide[:, a:a + BATCH], deep[:, a:a + BATCH], g)
            i = np.arange(len(g))
            out[a:a + BATCH] = lg[i, g] - np.log(sg) + lm[i, m] - np.log(sm)
        return out / np.log(10)

    def learn(self, tokens: Tokens, state: tuple[np.ndarray, np.ndarray]) -> None:
        """One AdaGrad step for each BATCH tokens; ``state`` holds the squared gradients of ``wide`` and ``deep``."""
        wide, deep = self.rows(tokens)
        group, member = np.divmod(tokens.classes, MEMBERS)
        for a in range(0, len(group), BATCH):
            g, m = group[a:a + BATCH], member[a:a + BATCH]
            w, d = wide[:, a:a + BATCH], deep[:, a:a + BATCH]
            i = np.arange(len(g))
            found = self._forward(w, d, g)
            for (_, odds, total), target, rows, weights, squares in (
                (found[0], g, w, self.wide, state[0]), (found[1], m, d + g, self.deep, state[1])
            ):
                slope = np.divide(odds, total[:, None], out=odds)
                slope.ravel()[i * slope.shape[1] + target] -= 1
                for r in rows:
                    own, sums = row_sums(slope, r)
                    seen = np.take(squares, own, axis=0, mode="clip")
                    seen += sums * sums
                    _put(squares, own, seen)
                    seen += np.float32(1.0)
                    np.sqrt(seen, out=seen)
                    sums *= np.float32(RATE)
                    sums /= seen
                    _put(weights, own, np.take(weights, own, axis=0, mode="clip") - sums)
