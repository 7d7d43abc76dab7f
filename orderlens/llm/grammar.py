"""Re-Pair grammars over many integer sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .base import mix


@dataclass
class Grammar:
    """Binary rules numbered from `first`, in the order of their making, and where they were applied.

    `left`, `right` are the symbols of each rule. `rule`, `start`, `inner`, `size` describe every
    node of the derivation: the rule, the first position, the length of its left part and of the whole.
    `symbols`, `owner`, `at` are what is left of the sequences: symbols, their sequence and position.
    `rounds` are borders in the list of rules: a round's rules use symbols of earlier rounds only.
    """

    first: int
    left: np.ndarray
    right: np.ndarray
    rule: np.ndarray
    start: np.ndarray
    inner: np.ndarray
    size: np.ndarray
    symbols: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    length: np.ndarray
    rounds: list[int]


def _even_twins(left: np.ndarray, right: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Pairs that do not overlap an equal pair before them: of a run `aaaa` only every second one counts."""
    twin = same & (left == right)
    index = np.arange(len(twin))
    opens = twin & ~np.concatenate(([False], twin[:-1]))
    begin = np.maximum.accumulate(np.where(opens, index, 0))
    return same & ~(twin & ((index - begin) % 2 == 1))


def re_pair(symbols: np.ndarray, owner: np.ndarray) -> Grammar:
    """Replaces repeated pairs until none occurs twice without overlap.

    `owner` numbers the sequence of each symbol; pairs never span two sequences. A round counts all
    pairs and replaces, together, each pair that is more frequent than every pair that overlaps it
    (ties: by a hash of the symbols, so that a chain of equally frequent pairs falls in a few rounds);
    the most frequent one is always among them.
    """
    n = len(symbols)
    symbols, owner = symbols.astype(np.int64), owner.astype(np.int64)
    at, length = np.arange(n), np.ones(n, np.int64)
    first = int(symbols.max()) + 1 if n else 0
    following = first
    rules: list[tuple] = []
    nodes: list[tuple] = []
    rounds = [0]
    live = np.ones(max(n - 1, 0), bool)
    while len(symbols) > 1:
        left, right = symbols[:-1], symbols[1:]
        usable = np.flatnonzero(_even_twins(left, right, owner[1:] == owner[:-1]) & live)
        keys, which, counts = np.unique((left[usable] << 32) | right[usable], return_inverse=True, return_counts=True)
        if not len(keys) or counts.max() < 2:
            break
        weight = np.zeros(len(left) + 2, np.int64)  # one place of room at each side
        turn = np.empty(len(keys), np.int64)
        turn[np.argsort(mix(keys), kind="stable")] = np.arange(len(keys))
        weight[usable + 1] = np.where(counts > 1, counts * len(keys) + turn, 0)[which]
        here = weight[1:-1]
        wins = (here[usable] > weight[usable]) & (here[usable] > weight[usable + 2])
        uses = np.bincount(which[wins], minlength=len(keys))
        wins &= uses[which] > 1
        number = np.cumsum(uses > 1) - 1
        spot = usable[wins]
        made = keys[uses > 1]
        rules.append((made >> 32, made & 0xFFFFFFFF))
        new = following + number[which[wins]]
        nodes.append((new, at[spot], length[spot], length[spot] + length[spot + 1]))
        following += len(made)
        rounds.append(following - first)
        # a pair that occurred once stays single unless one of its symbols is replaced
        single = np.zeros(len(left), bool)
        single[usable] = counts[which] > 1
        odd = live.copy()
        odd[usable] = False  # overlapping twins were not counted and stay open
        changed = np.zeros(len(symbols), bool)
        symbols = symbols.copy()
        symbols[spot] = new
        length = length.copy()
        length[spot] += length[spot + 1]
        changed[spot] = True
        keep = np.ones(len(symbols), bool)
        keep[spot + 1] = False
        open_pair = np.concatenate((single | odd, [False]))
        # the pair that starts at a kept symbol ends at the next kept one
        symbols, owner, at, length, changed = symbols[keep], owner[keep], at[keep], length[keep], changed[keep]
        live = (open_pair[keep][:-1] | changed[:-1] | changed[1:]) if len(symbols) > 1 else np.zeros(0, bool)

    def joined(parts, k):
        return np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    return Grammar(first, joined(rules, 0), joined(rules, 1), *[joined(nodes, k) for k in range(4)],
                   symbols, owner, at, length, rounds)


def fold_rest(grammar: Grammar) -> list[tuple]:
    """Joins what is left of each sequence by halves: one tuple (left, right) of positions a level.

    Returns per level (left index, right index, start, inner, size, keep), where the indexes point into
    the symbols of that level and `keep` are the symbols that go on, joined ones in their left part's
    place. After the last level every sequence is one symbol.
    """
    owner, at, length = grammar.owner, grammar.at, grammar.length
    levels = []
    while len(owner) and (owner[1:] == owner[:-1]).any():
        index = np.arange(len(owner))
        opens = np.concatenate(([True], owner[1:] != owner[:-1]))
        place = index - np.maximum.accumulate(np.where(opens, index, 0))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (owner[1:] == owner[:-1]))
        keep = np.ones(len(owner), bool)
        keep[left + 1] = False
        levels.append((left, left + 1, at[left], length[left], length[left] + length[left + 1], keep))
        length = length.copy()
        length[left] += length[left + 1]
        owner, at, length = owner[keep], at[keep], length[keep]
    return levels
