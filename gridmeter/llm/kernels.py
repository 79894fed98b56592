"""Vectorised text kernels over Arrow buffers: words, spans, polynomial hashes, packed blocks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All hashes are 64 bits wide,
polynomials modulo 2**64 with odd multipliers over randomised byte values, then mixed; long spans have BLAKE2.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_OTHER = U(0xD1342543DE82EF95)
_OTHER_INVERSE = U(pow(int(_OTHER), -1, 1 << 64))
_CHUNK = 1 << 18
#: Bytes from which a span is hashed by BLAKE2: polynomials modulo 2**64 have known collisions among long strings.
LONG_SPAN = 256
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: The same with A-Z read as a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's range of words (rows + 1 offsets)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A hash of each span of bytes. Starts ascend; equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
        low, high = int(starts[i]), int(ends[i:j].max())
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * powers(high - low), out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        back = powers(high - low + 1, _INVERSE)
        out[i:j] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
        i = j
    for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw.lower() if table is FOLDED else raw, digest_size=8).digest(), "little")
    return out


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every k consecutive words of a row; the row and the start (within the row) of each."""
    counts = np.diff(offsets)
    n = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[:-1][row] + start
    if not len(at):
        return np.zeros(0, np.uint64), row, start
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    return mix((sums[at + k] - sums[at]) * powers(len(hashes) + 1, _INVERSE)[at]), row, start


def checks(hashes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """32 bits of a second hash, of another base and other word values, of every window that windows() gives."""
    n = np.maximum(np.diff(offsets) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ _BASE) * powers(len(hashes), _OTHER), out=sums[1:])
    return (mix((sums[at + k] - sums[at]) * powers(len(hashes) + 1, _OTHER_INVERSE)[at]) >> U(32)).astype(np.uint32)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles of every row, with repeats; a shorter row has its whole sequence as one. Row of each, ascending."""
    found, row, _ = windows(hashes, offsets, k)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
        a, b = offsets[short], offsets[short + 1]
        whole = mix(mix((sums[b] - sums[a]) * powers(len(hashes) + 1, _INVERSE)[a]) + counts[short].astype(np.uint64))
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        found, row = found[order], row[order]
    return found, row


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in ascending order, and the offsets of the rows. rows ascend."""
    if not len(values):
        return values, np.zeros(n_rows + 1, np.int64)
    values = values.copy()
    edges = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()  # row by row, in the processor's cache, takes a tenth of a lexsort of all
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])  # rows ascend, so they stay in place
    rows = rows[new]
    return values[new], np.searchsorted(rows, np.arange(n_rows + 1))


def parity(tokens: np.ndarray, rows: np.ndarray, n_rows: int, words: int) -> np.ndarray:
    """n_rows x words 64-bit numbers: a bit for each of 64 x words classes of tokens, set where the row has an odd number of that class.

    Two rows' sketches differ in at most as many bits as their sets differ in tokens.
    """
    size = 64 * words
    bit = ((mix(tokens) >> U(32)) % U(size)).astype(np.int64)
    edges = np.searchsorted(rows, np.arange(0, n_rows + 1024, 1024))  # rows ascend; some at a time
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        n = min(1024, n_rows - 1024 * i)
        odd = np.bincount((rows[a:b] - 1024 * i) * size + bit[a:b], minlength=n * size).astype(np.uint8) & 1
        out.append(np.packbits(odd.reshape(n, size), axis=1, bitorder="little").view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, words), np.int64)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes, then all second ones and so on: what is alike stands together for the shuffle's codec."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    return np.int64(len(columns[0])).tobytes() + b"".join(planes(c) for c in columns)


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(block, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(block, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def unpack_all(blocks: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of all blocks, end to end; what is unpacked of a block goes straight to its place."""
    edges = np.cumsum([0, *(int(np.frombuffer(b, np.int64, 1)[0]) for b in blocks)])
    out = [np.empty(edges[-1], k) for k in kinds]
    for block, a, b in zip(blocks, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for whole, column in zip(out, unpack(block, *kinds), strict=True):
            whole[a:b] = column
    return out


def _murmur(value: int) -> int:
    """The hash by which repartition() deals out an int: Murmur3, 32 bits, seed 42."""
    m = 0xFFFFFFFF
    k = value * 0xCC9E2D51 & m
    k = (k << 15 | k >> 17) & m
    h = 42 ^ k * 0x1B873593 & m
    h = (h << 13 | h >> 19) & m
    h = (h * 5 + 0xE6546B64 & m) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def even_keys(n: int, each: int) -> np.ndarray:
    """each x n ints of which repartition(n, key) gives every partition exactly `each`."""
    found: list[list[int]] = [[] for _ in range(n)]
    missing, key = n, 0
    while missing:
        at = found[_murmur(key) % n]
        if len(at) < each:
            at.append(key)
            missing -= len(at) == each
        key += 1
    return np.array([keys[i] for i in range(each) for keys in found], np.int32)


def by_part(hashes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of an ascending array of hashes that fall into each of len(keys) equal ranges, with the range's key."""
    top = ((hashes >> U(32)) * U(len(keys))) >> U(32)
    cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(top)], strict=True):
        if b > a:
            yield int(keys[int(top[a])]), slice(a, b)


def trim() -> None:
    """Gives freed memory back, where the C library can: workers of several tasks share an executor."""
    if _libc is not None:
        _libc.malloc_trim(0)


def gathered(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Tables of some consecutive batches whose column holds at least limit bytes, and the rest.

    A batch that holds much more is cut, so that memory depends on limit and on the longest row.
    """
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())  # which gives memory back
    held, size = [], 0
    for batch in batches:
        for piece in _cut(batch, limit, column):
            held.append(piece)
            size += piece.column(column).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)
    held = []
    trim()


def _cut(batch: pa.RecordBatch, limit: int, column: str) -> Iterator[pa.RecordBatch]:
    if batch.num_rows <= 1 or batch.column(column).nbytes <= 2 * limit:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _cut(batch.slice(0, half), limit, column)
    yield from _cut(batch.slice(half), limit, column)
