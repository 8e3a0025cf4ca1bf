"""Suffix arrays by prefix doubling, and permuted common prefixes.

Suffixes are ranked by their first few symbols; each round sorts those that are
still tied by the rank of what follows, which doubles the symbols that decide.
Rank, rank of what follows and place fit one integer, so a round is a plain sort.
"""

from __future__ import annotations

import numpy as np

_WIDE = 7


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols below 2**9 whose last, 0, occurs only there."""
    n = len(t)
    bits, used = n.bit_length(), np.bincount(t) > 0
    code, each = (np.cumsum(used) - 1)[t], max(1, int(used.sum() - 1).bit_length())
    # As many symbols as fit beside the place.
    ahead = max(1, (63 - bits) // each)
    code = np.concatenate([code, np.zeros(ahead, np.int64)])
    key = code[:n].copy()
    for k in range(1, ahead):
        key <<= each
        key |= code[k : k + n]
    places, key = _sorted(key, np.arange(n, dtype=np.int32), bits + ahead * each <= 63, bits)
    sa, rank, at = places, np.empty(n, np.int32), np.arange(n, dtype=np.int32)
    while True:
        new = np.ones(len(at) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        head = np.flatnonzero(new)
        # A suffix's rank is the place of the first one that it ties with.
        rank[places] = np.repeat(at[head[:-1]], np.diff(head))
        at = at[~(new[:-1] & new[1:])]
        if not len(at):
            return sa
        # The end occurs once, so tied suffixes have that many symbols.
        places = sa[at]
        key = rank[places].astype(np.int64)
        key <<= bits
        key |= rank[places + ahead]
        places, key = _sorted(key, places, 3 * bits <= 63, bits)
        sa[at] = places
        ahead *= 2


def _sorted(key: np.ndarray, places: np.ndarray, room: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` and their keys by key, which may have room for the place."""
    if not room:
        by = np.argsort(key, kind="stable")
        return places[by], key[by]
    key <<= bits
    key |= places
    key.sort()
    return (key & ((1 << bits) - 1)).astype(np.int32), key >> bits


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``sa`` the common prefix with the suffix before it, up to ``most`` or a little over.

    ``sa`` holds all suffixes or some, in order.  They are computed in text order: where the
    suffix one symbol longer follows the longer one of the suffix before, and both begin
    alike, the common prefix is one less than theirs.
    """
    n = len(t)
    before = np.full(n + 1, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.flatnonzero(before >= 0)
    # Of the text's first suffix none is longer: the look-up at -1 finds none.
    own, longer = before[place], before[place - 1]
    fresh = (longer < 0) | (longer + 1 != own) | (t[place - 1] != t[own - 1])
    head = np.flatnonzero(fresh)
    runs = np.diff(np.append(head, len(place)))
    i, j = place[head], own[head].astype(np.int64)
    # Seven symbols of at most nine bits at a time, as one word.
    wide = np.concatenate([t.astype(np.int64), np.zeros(_WIDE, np.int64)])
    word = wide[:n].copy()
    for k in range(1, _WIDE):
        word <<= 9
        word |= wide[k : k + n]
    size = np.zeros(len(head), np.int64)
    # A run that goes on from a fresh place may need what lies further back.
    need = most + _WIDE + runs
    for step, symbols in ((_WIDE, word), (1, t)):
        todo, rounds = np.arange(len(head)), 0
        while len(todo) and (step > 1 or rounds < _WIDE):
            a, b = i[todo] + size[todo], j[todo] + size[todo]
            ok = (a < n) & (b < n)
            ok[ok] = symbols[a[ok]] == symbols[b[ok]]
            todo = todo[ok]
            size[todo] += step
            todo, rounds = todo[size[todo] < need[todo]] if step > 1 else todo, rounds + 1
    permuted = np.zeros(n, np.int64)
    permuted[place] = np.maximum(np.repeat(size, runs) - (np.arange(len(place)) - np.repeat(head, runs)), 0)
    return permuted[sa]
