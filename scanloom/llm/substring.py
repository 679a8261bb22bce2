"""Exact repeated word windows by super-k-mers: runs of windows that share a minimiser travel packed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from scanloom.llm.repeats import Spans, Unit, mixed, without_repeats

WIDTH, ANCHOR = 20, 3  # words
CACHED_WORDS = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Words are what ASCII white space separates, which is what bytes.split() splits at."""
    return (text or "").encode("utf-8", "replace").split()


def repeated_windows(strings: list[bytes], width: int) -> np.ndarray:
    """For every window of every packed string, in order: does an earlier window have the same words?

    Words become numbers by their bytes; sorting brings equal windows together, and neighbours of equal hash are
    compared word by word.
    """
    split = [s.split(b" ") for s in strings]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    windows = sizes - width + 1
    total = int(windows.sum())
    flags = np.zeros(total, bool)
    if not total:
        return flags
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64)
    starts = np.arange(total) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(windows) - windows), windows)
    hashed = Spans(mixed(ids.view(np.uint64) + np.uint64(1))).hashed(starts, starts + width)
    ranked = np.argsort(hashed, kind="stable")
    same = np.flatnonzero(hashed[ranked[1:]] == hashed[ranked[:-1]])
    span = np.arange(width)
    equal = np.ones(len(same), bool)
    for at in range(0, len(same), 1 << 16):
        part = same[at:at + (1 << 16)]
        equal[at:at + (1 << 16)] = (ids[starts[ranked[part]][:, None] + span] == ids[starts[ranked[part + 1]][:, None] + span]).all(1)
    if equal.all():
        flags[ranked[same + 1]] = True
        return flags
    shared = np.unique(np.concatenate([ranked[same], ranked[same + 1]]))  # different windows of one hash: sort by words
    rows = ids[starts[shared][:, None] + span]
    order = np.lexsort(rows.T[::-1])
    flags[shared[order[1:]]] = (rows[order[1:]] == rows[order[:-1]]).all(1)
    return flags


WORDS = Unit(WIDTH, ANCHOR, split_words, word_hashes, b" ".join, repeated_windows)


def _result(words: list[bytes], gone: np.ndarray) -> list:
    kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
    return [len(words), int(gone.sum()), b" ".join(kept).decode()]


def drop_repeated_words(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of every row with n_words, n_removed and ``kept`` (the words left, joined by one space).

    Removed is every word of a 20-word window whose words start earlier too, in the input. Null has no words.
    """
    return without_repeats(docs, WORDS, keep or docs.columns, _result, [
        ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept", pa.string(), "string")])
