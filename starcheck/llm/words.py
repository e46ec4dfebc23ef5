"""Words and window hashes of whole texts, many documents at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: bytes.split() cuts at exactly these bytes: space and \\t \\n \\v \\f \\r.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
_CACHED = 300_000


class Codes(dict):
    """A 64-bit code for each word; the cache is emptied when it holds many words."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHED:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= _CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values evenly (the finishing step of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hash(codes: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each window of `length` codes, by doubling: two windows side by side make one."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    done, out, block, size = 0, None, codes, 1
    power = base & (2**64 - 1)
    n = len(codes) - length + 1
    while True:
        if length & size:
            part = block[done : done + n]
            out = part if out is None else out * np.uint64(power) + part
            done += size
        if done == length:
            return mix(out)
        block = block[:-size] * np.uint64(power) + block[size:]
        power = power * power & (2**64 - 1)
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about SLICE_BYTES of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
