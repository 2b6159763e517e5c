"""Re-Pair on one block of token ids, in array passes: frequent neighbours become nonterminals, round by round."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs taken up in one round (numbered in 16 bits), the least uses of a rule, and when to stop: rounds, or a round that saves less.
PAIRS, LEAST_USES, ROUNDS, LEAST_SAVING = 2048, 4, 14, 0.02
SLOT_BITS = 19
NO_SLOT = 1 << SLOT_BITS
#: Nonterminals are numbered from here; a vocabulary must be smaller.
FIRST_RULE = 1 << 20
#: Stands where a document ends; no id of a vocabulary, and in no rule, so every document begins at a symbol.
SEPARATOR = FIRST_RULE - 1
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * _A) ^ (right * _B) * _A) >> np.uint32(32 - SLOT_BITS)


def _sizes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    is_rule = symbols >= FIRST_RULE
    out[is_rule] = lengths[symbols[is_rule] - FIRST_RULE]
    return out


def _unfold(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Replaces rules by their pairs until none is left."""
    out = symbols
    while (is_rule := out >= FIRST_RULE).any():
        at = np.arange(len(out)) + np.concatenate([[0], np.cumsum(is_rule)[:-1]])
        longer = np.empty(len(out) + int(is_rule.sum()), np.uint32)
        longer[at] = out
        pair = rules[out[is_rule] - FIRST_RULE]
        longer[at[is_rule]], longer[at[is_rule] + 1] = pair[:, 0], pair[:, 1]
        out = longer
    return out


@dataclass
class Grammar:
    """``symbols`` derive the ids: below FIRST_RULE an id is itself, above it is row ``id - FIRST_RULE`` of ``rules``.

    ``lengths`` are the ids each rule expands to. A rule refers to earlier rules only.
    """

    symbols: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    unfolded: np.ndarray | None = None

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return _sizes(symbols, self.lengths)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that ``symbols`` (any slice of the block's) stand for: each rule is unfolded once, then looked up."""
        if self.unfolded is None:
            self.unfolded = _unfold(np.arange(len(self.rules), dtype=np.uint32) + np.uint32(FIRST_RULE), self.rules)
        symbols = symbols.astype(np.uint32)
        sizes = self.sizes(symbols)
        out = np.repeat(symbols, sizes)
        of_rule = np.flatnonzero(out >= FIRST_RULE)
        if len(of_rule):
            used = np.flatnonzero(symbols >= FIRST_RULE)
            rule, size = symbols[used] - FIRST_RULE, sizes[used]
            begin = np.cumsum(self.lengths) - self.lengths
            shift = begin[rule] - (np.cumsum(size) - size)
            out[of_rule] = self.unfolded[np.repeat(shift, size) + np.arange(len(of_rule))]
        return out

    def slice(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the ``first`` on, expanding only the symbols they lie in."""
        ends = np.cumsum(self.sizes(self.symbols))
        a = int(np.searchsorted(ends, first, side="right"))
        b = int(np.searchsorted(ends, first + count, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[first - skipped:first - skipped + count]


def compress(ids: np.ndarray) -> Grammar:
    """The grammar of a block: ids, with SEPARATOR behind each document.

    A round counts pairs by hash slot, takes the most frequent slots' pairs, and replaces their occurrences; where two
    occurrences overlap the more frequent pair wins. Pairs that got too few uses this way are left alone.
    """
    seq, rules = ids.astype(np.uint32), []
    lengths, made = np.zeros(0, np.int64), 0
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        left, right = seq[:-1], seq[1:]
        slot = _slots(left, right).astype(np.intp)
        ends = np.flatnonzero(seq == SEPARATOR)
        slot[ends[ends < len(slot)]] = slot[ends[ends > 0] - 1] = NO_SLOT  # no pair reaches over a document's end
        counts = np.bincount(slot, minlength=NO_SLOT + 1)[:NO_SLOT]
        if counts.max() < LEAST_USES:
            break
        top = np.flatnonzero(counts >= LEAST_USES)
        if len(top) > PAIRS:
            top = top[np.argpartition(counts[top], -PAIRS)[-PAIRS:]]
        top = top[np.argsort(-counts[top], kind="stable")]
        rank_of = np.full(NO_SLOT + 1, len(top), np.int16)
        rank_of[top] = np.arange(len(top), dtype=np.int16)
        rank = rank_of[slot]
        known = np.flatnonzero(rank < len(top))
        rank = rank[known]
        holder = np.empty(len(top), np.intp)
        holder[rank] = known
        pair_left, pair_right = left[holder], right[holder]
        fits = (left[known] == pair_left[rank]) & (right[known] == pair_right[rank])
        known, rank = known[fits], rank[fits]
        beside = np.diff(known) == 1  # the next occurrence overlaps
        better = rank[:-1] <= rank[1:]
        won = np.ones(len(known), bool)
        won[:-1] &= ~beside | better
        won[1:] &= ~beside | ~better
        chosen, rank = known[won], rank[won]
        uses = np.bincount(rank, minlength=len(top))
        useful = uses >= LEAST_USES
        chosen, rank = chosen[useful[rank]], rank[useful[rank]]
        if len(chosen) < LEAST_SAVING * len(seq):
            break
        number = np.cumsum(useful) - 1 + made
        kept = np.ones(len(seq), bool)
        kept[chosen + 1] = False
        pairs = np.stack([pair_left[useful], pair_right[useful]], axis=1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, _sizes(pairs[:, 0], lengths) + _sizes(pairs[:, 1], lengths)])
        made += int(useful.sum())
        seq[chosen] = (number[rank] + FIRST_RULE).astype(np.uint32)
        seq = seq[kept]
    none = np.zeros((0, 2), np.uint32)
    return Grammar(seq, np.concatenate(rules) if rules else none, lengths)
