"""Words and word shingles inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

# At most so many words keep their hash in a Python worker; beyond it the memo starts anew.
MEMO_WORDS = 500_000
_memo: dict[bytes, int] = {}

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8. Null has none."""
    return text.encode().lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    try:
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_memo) > MEMO_WORDS:
            _memo.clear()
        for word in words:
            if word not in _memo:
                _memo[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def forget_words() -> None:
    """Call at a task's end: a worker that waits, or serves another step, holds no words."""
    _memo.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words give none."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = hashes_of(words)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        total = total * _ODD + hashed[i : len(words) - width + 1 + i]
    return np.unique(mix(total))


def shingle_set(words: list[bytes], size: int) -> set:
    """The shingles themselves, for exact comparison."""
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(size)]))
