"""Words and word n-grams as 64-bit hashes in numpy, for use inside Arrow tasks.

bytes.split() cuts at exactly the six ASCII white-space characters, so words of
UTF-8 text are the runs of anything else.  N-gram hashes are polynomials of word
hashes modulo 2**64, taken from running sums and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; bounds a task's memory whatever the batch holds.
CHUNK_BYTES = 2_000_000
CACHE_WORDS = 400_000


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words met most recently."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            one = np.ones(1, np.uint64)
            self.up = np.concatenate([one, np.cumprod(np.full(n, BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n, _INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser (Steele, Lea, Flood 2014)."""
    x = x ^ np.uint64(salt) if salt else x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Grams:
    """Hashes of the k-word sequences that begin at each word of some documents laid end to end."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.n = len(hashes)
        up, self.down = POWERS.get(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up, out=self.sums[1:])

    def of(self, k: int, salt: int = 0) -> np.ndarray:
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:m]) * self.down[:m], salt + k)


def ranges(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """A column of texts in ranges (begin, end) of together at most so many bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, size in enumerate([*sizes.tolist(), None]):
        if size is None or total and total + size > most:
            if i > begin:
                yield begin, i
            begin, total = i, 0
        total += size or 0


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """The ranges of a column with their texts as UTF-8, empty for nulls."""
    column = column.cast(pa.binary())
    for begin, end in ranges(column, most):
        yield begin, end, [x or b"" for x in column.slice(begin, end - begin).to_pylist()]
