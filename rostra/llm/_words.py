"""Words of Arrow string columns, vectorised: whole batches become integer codes and a small vocabulary."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def byte_table(is_member) -> np.ndarray:
    return np.array([is_member(b) for b in range(256)], dtype=bool)


#: Separators of `[^\x20\x09-\x0D]+`.
WHITE = byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
NOT_ALNUM = byte_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 2 << 20
#: The same for functions whose arrays of a slice take many times its bytes.
SMALL_SLICE = 1 << 20


def give_back() -> None:
    """Freed memory goes back to the system. A worker that waits for its next task holds it otherwise, as does each heap that
    the arrays of a slice have stretched."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """run, a function of Arrow batches, that gives back what it freed whenever it has made a batch, and at its end."""

    def tidied(batches):
        try:
            for made in run(batches):
                yield made
                del made
                give_back()
        finally:
            give_back()

    return tidied


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and where each begins (one more at the end). Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE):
    """(first text, bytes, offsets) of groups of neighbouring texts."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        end = min(end, n)
        yield begin, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


class Words:
    """Words of some texts. codes: a number for each word in order; vocabulary: the words by number (bytes);
    bounds: text i has words bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True, kinds: np.ndarray | None = None):
        """kinds: a number for each byte value; where given, words also end where it changes, and at each byte of kind 0."""
        data = LOWER[data] if lower else data
        inside = ~separators[data]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edge - 1] = inside[edge - 1]
        if kinds is not None:
            kind = kinds[data]
            cut = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
            first[1:] |= cut & inside[1:]
            last[:-1] |= cut & inside[:-1]
        begin = np.flatnonzero(first)
        ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begin)]).astype(np.int32 if len(data) < 2**31 else np.int64)
        kind = pa.binary() if ends.dtype == np.int32 else pa.large_binary()
        words = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words = coded.dictionary
        self.bounds = np.searchsorted(begin, offsets)

    @property
    def vocabulary(self) -> list[bytes]:
        return self.words.to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each vocabulary word."""
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def texts(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbouring words (over text bounds too; callers drop those)."""
    if len(word_hashes) < size:
        return np.empty(0, np.uint64)
    n = len(word_hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix64(out + word_hashes[k : k + n] + np.uint64(k + 1))
    return out
