"""Polynomial hashes of words, windows and substrings, over whole arrays at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.common import mix64

#: Odd multipliers of the two hashes: odd numbers have an inverse modulo 2**64.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def joined_bytes(strings: pa.Array) -> bytes:
    """The strings' bytes end to end."""
    if not len(strings):
        return b""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings), "")[0].as_buffer().to_pybytes()


class Substrings:
    """Hashes of any substrings of some bytes, from prefix sums."""

    def __init__(self, data: bytes):
        terms = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(terms) + 1, np.uint64)
        np.cumsum(terms * _powers(BASES[0], len(self.sums))[:-1], out=self.sums[1:])
        self.inverse = _powers(np.uint64(pow(int(BASES[0]), -1, 1 << 64)), len(self.sums))

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The hash of the `size` bytes at each start."""
        return mix64((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word: polynomials in the bytes, mixed with the length. One pass over the bytes of the distinct words."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    sizes = np.asarray(pc.binary_length(distinct), dtype=np.int64)
    ends = np.cumsum(sizes)
    starts, data = ends - sizes, np.frombuffer(joined_bytes(distinct), np.uint8).astype(np.uint64) + np.uint64(1)
    which, out = np.asarray(coded.indices, dtype=np.int64), []
    for base in BASES:
        n = len(data) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(data * _powers(base, n)[:-1], out=sums[1:])
        value = (sums[ends] - sums[starts]) * _powers(np.uint64(pow(int(base), -1, 1 << 64)), n)[starts]
        out.append(mix64(value + sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))[which])
    return out[0], out[1]
