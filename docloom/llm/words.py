"""Words, word hashes and shingle hashes of whole texts, over the bytes of Arrow columns.

Every operator that needs words of long texts reads the UTF-8 bytes of an Arrow string column
directly, so that no Python object is made per word. A word hash is a polynomial over random
byte values modulo 2**64, brought to position 0 and mixed; a shingle hash combines word hashes.
Hashes depend on the bytes alone: they agree between tasks, runs and machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

U64 = np.uint64


def _return_freed_memory() -> None:
    """Keeps glibc from raising its limits for large blocks, so that a Python worker gives back what it has freed."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 23)  # M_MMAP_THRESHOLD: arrays of a slice come from the heap, larger ones are returned when freed
        libc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


if TaskContext.get() is not None:  # in a worker; the driver's process keeps its settings
    _return_freed_memory()
#: Bytes handled at once; bounds the memory of a task whatever the batch. Longer texts go alone.
PIECE = 1 << 19
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


def byte_class(pattern: str) -> np.ndarray:
    """Which of the 256 bytes belong to words: "spaced" splits at 20, 09-0D; "alnum" keeps a-z, 0-9 and 80-FF."""
    t = np.zeros(256, bool)
    if pattern == "spaced":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    else:
        raise ValueError(pattern)
    return t


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_SPACED, _ALNUM = byte_class("spaced"), byte_class("alnum")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MUL, _INV):
        p = np.full(size, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them; a null counts as empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about `most` bytes together; one longer text goes alone."""
    if not batch.num_rows:
        return
    _, o = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(o, o[at] + most, "right")) - 1
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a column of texts: start and end bytes, hash, and for each text the range of its words."""

    def __init__(self, col: pa.Array, kind: str):
        raw, self.offsets = string_bytes(col)
        self.data = LOWER[raw]
        inside = (_SPACED if kind == "spaced" else _ALNUM)[self.data]
        begins = self.offsets[:-1]
        begins = begins[(begins < len(self.data))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[begins] = inside[begins]
        self.start = np.flatnonzero(first)
        last = inside
        closing = begins[begins > 0] - 1
        tail = inside[closing]
        last[:-1] &= ~inside[1:]
        last[closing] = tail
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        at = 0
        while at < len(out):  # segment by segment: the arrays of 8 bytes per byte stay small for very long texts
            lo = self.start[at]
            to = max(int(np.searchsorted(self.end, lo + PIECE, "right")), at + 1)
            hi = self.end[to - 1]
            up, down = _powers(max(PIECE, 1 << int(hi - lo).bit_length()) + 1)
            c = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE[self.data[lo:hi]] * up[: hi - lo], out=c[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = mix((c[e] - c[s]) * down[s] + (e - s).astype(U64))
            at = to
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, whether or not they cross from one text into the next."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, k, U64)
    for j in range(k):
        acc = acc * U64(_MUL) + h[j : j + n]
        acc ^= acc >> U64(29)
    return mix(acc)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingle hashes, sorted; one of all its words where they are fewer."""
    g, out = gram_hash(words.hash, k), []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(gram_hash(words.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def hash_words(phrase: list[str]) -> np.ndarray:
    """The hashes that Words gives to these words."""
    return Words(pa.array([" ".join(phrase)], pa.string()), "spaced").hash


def shrink(x: np.ndarray) -> bytes:
    """Whole numbers of up to 64 bits, compressed byte plane by byte plane: most bytes of the upper planes are 0."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def grow(raw) -> np.ndarray:
    """What shrink took, as int64."""
    raw = memoryview(raw).cast("B")
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(pa.decompress(raw[9:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return wide.view(np.int64)[:, 0]


def pack_rows(x: np.ndarray) -> bytes:
    """A structured array, compressed byte column by byte column."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_rows(raw, n: int, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * kind.itemsize, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)
