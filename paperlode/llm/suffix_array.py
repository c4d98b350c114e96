"""Suffix arrays built blockwise with a difference cover.

The suffixes that stand at given positions are sorted one bucket (a range of leading words) at a time.
Inside a bucket they are compared by their first V bytes. Suffixes that tie there are told apart by the
precomputed ranks of a difference-cover sample alone: for residues a and b modulo V some shift d < V takes
both into the cover, and the ranks of the shifted suffixes decide. A tie is cut by residues; each pair
of residues is compared at its own shift, and a suffix's place is the number of those before it. So what
a bucket needs is two words and a count a suffix, whatever the length of the ties. Ranks are exact to
DEPTH bytes, more than any comparison here asks for.
"""

from __future__ import annotations

import numpy as np

V = 16
#: A difference cover modulo 16: every residue is a difference of two members (fixed values).
COVER = (0, 1, 2, 5, 8)
#: Bytes to which ranks of the sample are exact, and suffixes sorted at a time.
DEPTH, BUCKET = 64, 1 << 17
_IN_COVER = np.isin(np.arange(V), COVER)
#: SHIFT[a, b]: the smallest d that takes both residues into the cover.
SHIFT = np.array([[next(d for d in range(V) if _IN_COVER[(a + d) % V] and _IN_COVER[(b + d) % V]) for b in range(V)] for a in range(V)])


def big_endian_words(text: np.ndarray) -> np.ndarray:
    """text[i : i + 8] as an integer that sorts as the bytes do, for every i; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def _at(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """words at places, zero past the end."""
    return np.where(places < len(words), words[np.minimum(places, len(words) - 1)], np.uint64(0))


def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks by keys in a given order; equal keys have one rank."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(words: np.ndarray) -> np.ndarray:
    """For every position of the cover sample its rank to DEPTH bytes (others: -1)."""
    places = np.flatnonzero(_IN_COVER[np.arange(len(words)) % V])
    rank = _dense(order := np.argsort(words[places], kind="stable"), [words[places]])
    for k in range(1, DEPTH // 8):  # ranks of 8 k bytes, refined by the next word where they tie
        size = np.bincount(rank)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        following = _at(words, places[tied] + 8 * k)
        order = np.lexsort((following, rank[tied]))
        fine = _dense(order, [rank[tied], following])
        first = np.full(int(rank.max()) + 1, len(rank), np.int64)
        np.minimum.at(first, rank[tied], fine)
        bonus = np.zeros(len(rank), np.int64)
        bonus[tied] = fine - first[rank[tied]]
        rank = _dense(np.lexsort((bonus, rank)), [rank, bonus])
    out = np.full(len(words), -1, np.int64)
    out[places] = rank
    return out


def sorted_suffixes(text: np.ndarray, places: np.ndarray, words: np.ndarray | None = None):
    """Yields, bucket by bucket in order, places sorted by the suffixes that begin there.

    Suffixes are in order to DEPTH bytes at least; a bucket never splits suffixes that share a word.
    words: big_endian_words(text), where the caller has them."""
    if not len(places):
        return
    words = big_endian_words(text) if words is None else words
    ranks = cover_ranks(words)
    lead = words[places]
    by_lead = np.argsort(lead, kind="stable")
    lead, places = lead[by_lead], places[by_lead]
    start = 0
    while start < len(places):
        end = min(start + BUCKET, len(places))
        if end < len(places):
            end = int(np.searchsorted(lead, lead[end - 1], "right"))
        yield _sort_bucket(words, ranks, places[start:end])
        start = end


def _sort_bucket(words: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    first, second = words[places], _at(words, places + 8)
    order = np.lexsort((second, first))
    places, first, second = places[order], first[order], second[order]
    new = np.ones(len(places), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    if len(sizes) == len(places):
        return places
    smaller = np.zeros(len(places), np.int64)  # suffixes of the tie that come before
    heads = np.flatnonzero(new)
    twos = heads[sizes == 2]
    a, b = places[twos], places[twos + 1]
    d = SHIFT[a % V, b % V]
    swap = _ranks_at(ranks, a + d) > _ranks_at(ranks, b + d)
    smaller[twos[swap]] = 1
    smaller[twos[~swap] + 1] = 1
    rest = np.flatnonzero(sizes[group] > 2)
    if len(rest):
        smaller[rest] = _count_smaller(ranks, places[rest], group[rest])
    return places[np.lexsort((smaller, group))]


def _ranks_at(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at places of the cover; past the end of the text -1."""
    return np.where(places < len(ranks), ranks[np.minimum(places, len(ranks) - 1)], -1)


def _count_smaller(ranks: np.ndarray, places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each place how many places of its group have a smaller suffix, by one search a pair of residues."""
    top, out = np.int64(len(ranks) + 2), np.zeros(len(places), np.int64)
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    residue = places % V
    classes = [np.flatnonzero(residue == r) for r in range(V)]
    keys = lambda r, d: group[classes[r]] * top + _ranks_at(ranks, places[classes[r]] + d) + 1
    sorted_keys: dict[tuple[int, int], np.ndarray] = {}
    for r in range(V):
        for q in range(V):
            if not len(classes[r]) or not len(classes[q]):
                continue
            d = int(SHIFT[r, q])
            if (q, d) not in sorted_keys:
                sorted_keys[q, d] = np.sort(keys(q, d))
            held = sorted_keys[q, d]
            own = group[classes[r]] * top
            out[classes[r]] += np.searchsorted(held, keys(r, d)) - np.searchsorted(held, own)
    return out


def equal_prefix(text: np.ndarray, places: np.ndarray, length: int, words: np.ndarray | None = None) -> np.ndarray:
    """Whether the suffix at each place shares ``length`` bytes with the one before it in the order."""
    words = big_endian_words(text) if words is None else words
    whole = places + length <= len(text)
    same = np.zeros(len(places), bool)
    same[1:] = whole[1:] & whole[:-1]
    live = np.flatnonzero(same)
    for k in range(0, length, 8):
        a, b = _at(words, places[live] + k), _at(words, places[live - 1] + k)
        if length - k < 8:  # only the leading bytes count
            a, b = a >> np.uint64(8 * (8 - length + k)), b >> np.uint64(8 * (8 - length + k))
        same[live[a != b]] = False
        live = live[a == b]
    return same
