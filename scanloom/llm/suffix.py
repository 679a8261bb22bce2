"""Exact repeated byte strings by suffix arrays and longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm.repeats import Unit, without_repeats

WIDTH, ANCHOR = 100, 24  # bytes

_TABLE = np.random.default_rng(2024).integers(0, 1 << 64, 256, np.uint64)


def nearest_smaller(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest common prefix with the nearest earlier rank of smaller text position (0 without one).

    ``lcp[i]`` belongs to ranks i - 1 and i. Pointers jump over larger positions, all ranks at once; one stops where
    nothing is common any more.
    """
    at, low = np.arange(len(order)) - 1, lcp.copy()
    going = np.flatnonzero((at >= 0) & (low > 0))
    going = going[order[at[going]] > order[going]]
    while len(going):
        low[going] = np.minimum(low[going], low[at[going]])
        at[going] = at[at[going]]
        going = going[(at[going] >= 0) & (low[going] > 0)]
        going = going[order[at[going]] > order[going]]
    low[at < 0] = 0
    return low


def longest_previous_factors(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF by rank: the longer match of the previous and the next smaller position in suffix order."""
    back = np.concatenate([[0], lcp[:0:-1]]) if len(lcp) else lcp
    return np.maximum(nearest_smaller(order, lcp), nearest_smaller(order[::-1], back)[::-1])


SEPARATOR = 256  # between strings; no byte equals it
FIRST = 4  # symbols of 9 bits that share a sort key with a position


def sorted_by(groups: np.ndarray, inner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by two keys of at least 0 (``groups`` dense and rising, ``inner`` below ``most``), ties in their order,
    and where the keys change. Keys and row number share one number where they fit, which sorts faster than an order."""
    n = len(inner)
    bits, low = max(1, n - 1).bit_length(), max(1, most - 1).bit_length()
    key = (groups.astype(np.int64) << low) | inner
    if n and int(groups[-1]).bit_length() + low + bits <= 63:
        key <<= bits
        key |= np.arange(n)
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of ``text`` ordered by their first ``depth`` symbols or more, later ones first on ties, and the ranks after
    every doubling as (symbols compared, rank by position, -1 at the end). A rank is the place of the first suffix of its
    group."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(FIRST):
        key <<= 9
        key[:max(0, n - k)] |= text[k:] + 1
    order, head = sorted_by(np.zeros(n, np.int64), key[::-1], 1 << 9 * FIRST)
    del key
    order = n - 1 - order
    tied = np.arange(n)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, tied, 0))
    known, levels = FIRST, [(FIRST, rank)]
    while known < depth:
        same = np.concatenate([~head[1:], [False]])
        same[1:] |= ~head[1:]
        tied, head = tied[same], head[same]
        if not len(tied):
            break
        at = order[tied]
        second = rank[at + known] + np.int64(1)  # a suffix that ends before is tied with none
        turn, head = sorted_by(np.cumsum(head) - 1, second, n + 1)  # groups stay in their places, and ties in their order
        order[tied] = at = at[turn]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
        known *= 2
        levels.append((known, rank))
    return order, levels


def common_prefixes(text: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], least: int = 0) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in ``order``, as far as the ranks tell; 0 if below ``least``."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    known, rank = levels[-1]
    same = rank[order[1:]] == rank[order[:-1]]
    lcp[1:][same] = known
    rest = np.flatnonzero(~same) + 1  # they differ before ``known`` symbols
    one, two = order[rest - 1], order[rest]
    length = np.zeros(len(rest), np.int64)
    for known, rank in reversed(levels[:-1]):
        length += np.where(rank[one + length] == rank[two + length], known, 0)
        if least:
            far = length + known > least  # fewer than ``known`` symbols are still to come
            rest, one, two, length = rest[far], one[far], two[far], length[far]
    padded = np.append(text, [-1])
    for _ in range(FIRST - 1):
        lcp[rest] = length
        more = padded[one + length] == padded[two + length]
        rest, one, two, length = rest[more], one[more], two[more], length[more] + 1
    lcp[rest] = length
    lcp[lcp < least] = 0
    return lcp


def repeated_suffixes(strings: list[bytes], width: int) -> np.ndarray:
    """For every window of every string, in order: does an earlier window have the same bytes?

    All suffixes of the strings, set apart by separators, take part. A window starts earlier too if its longest previous
    factor has ``width`` bytes; the window itself holds no separator, so neither does what it equals. Shorter common
    prefixes count as none.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = sizes - width + 1
    total = int(windows.sum())
    if not total:
        return np.zeros(0, bool)
    ends = np.cumsum(sizes + 1)
    text = np.full(int(ends[-1]), SEPARATOR, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8)
    order, levels = suffix_array(text, width)
    factors = np.empty(len(text), np.int64)
    factors[order] = longest_previous_factors(order, common_prefixes(text, order, levels, width))
    starts = np.arange(total) + np.repeat((ends - sizes - 1) - (np.cumsum(windows) - windows), windows)
    return factors[starts] >= width


BYTES = Unit(WIDTH, ANCHOR, lambda text: (text or "").encode("utf-8", "replace"), lambda data: _TABLE[np.frombuffer(data, np.uint8)],
             bytes, repeated_suffixes, block=1 << 18)  # a suffix array takes about 100 bytes for each byte; smaller ones fit the caches


def _result(data: bytes, gone: np.ndarray) -> list:
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    return [len(data), int(gone.sum()), n_spans, kept]


def drop_repeated_bytes(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, n_removed, n_spans and ``kept`` (bytes; a cut may part a character).

    Removed is every byte of a 100-byte string that starts earlier too, in the input. Null is the empty text.
    """
    return without_repeats(docs, BYTES, keep or docs.columns, _result, [
        ("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept", pa.binary(), "binary")])


