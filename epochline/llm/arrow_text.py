"""Texts as byte arrays: what the operators that look at every byte or word share.

An Arrow string column already is one run of UTF-8 bytes with offsets, so numpy can work on a whole
batch without making a Python string per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most `rows` rows, so that a task holds a few MB of text at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(name))
    if current <= 0 or current > rows:
        spark.conf.set(name, str(rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one offset more than texts). Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes each; a longer text is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


_rng = np.random.Generator(np.random.PCG64(20240607))
#: One odd 64-bit number per byte; A-Z share those of a-z where case is folded.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: White space and all other ASCII characters that are neither letters nor digits.
NOT_ALNUM = ~np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts, with A-Z lowered: start, end, 64-bit hash and row of each.

    `space` can name other bytes than those of ASCII white space as what stands between words; `values=BYTE`
    tells capitals from small letters.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE, values: np.ndarray = FOLDED):
        n = len(data)
        self.space, self.values = space, values
        solid = ~space[data]
        first = np.zeros(n + 1, bool)  # a text boundary ends a word as white space does
        first[off[:-1]] = True
        first = first[:n]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        begins = solid & (~before | first)
        self.start = np.flatnonzero(begins)
        gap = np.empty(n, bool)
        if n:
            gap[-1] = True
            gap[:-1] = ~solid[1:] | first[1:]
        self.end = np.flatnonzero(solid & gap) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        #: Words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, off)
        self.hash = self._hashes(data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        longest = int(lengths.max())
        powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _POWERS[0], np.uint64))
        at = np.arange(len(data)) - np.repeat(self.start, np.diff(np.append(self.start, len(data)))) if not self.start[0] else None
        if at is None:
            at = np.zeros(len(data), np.int64)
            at[self.start[0] :] = np.arange(self.start[0], len(data)) - np.repeat(self.start, np.diff(np.append(self.start, len(data))))
        # bytes of the white space after a word count nothing
        value = self.values[data]
        value[self.space[data]] = U64(0)
        value *= powers[np.minimum(at, longest - 1)]
        sums = np.add.reduceat(value, self.start)
        return mix(sums + lengths.astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `k` words within each text, and the row of each; a shorter text gives its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - j] = h[j:]
        out = mix(out + shifted * U64(2 * j + 3))
    last = words.first[words.row + 1]
    whole = np.arange(n) + k <= last
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return out[whole], words.row[whole]
    extra = np.zeros(len(short), np.uint64)
    for i, row in enumerate(short):
        total = np.array([counts[row] + 1_000_003], np.uint64)
        for w in range(words.first[row], words.first[row + 1]):
            total = mix(total * U64(3) + h[w])
        extra[i] = total[0]
    return np.concatenate([out[whole], extra]), np.concatenate([words.row[whole], short])


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as the signed numbers that Spark has."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
