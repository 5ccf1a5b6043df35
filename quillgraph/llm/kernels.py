"""Array kernels shared by the text operators.

Texts reach the Python workers as Arrow batches.  The kernels work on the UTF-8
bytes of a few megabytes of text at once: words and byte windows become 64-bit
polynomial hashes with a handful of numpy passes, and rows travel between
stages as packed arrays (one binary cell per chunk and target partition), so a
shuffle moves few, dense records.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once by a worker.
CHUNK_BYTES = 4 << 20
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

_MASK = (1 << 64) - 1
_Q = 0x9E3779B97F4A7C15 | 1
_R = 0xD1342543DE82EF95


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.array([splitmix(i) | 1 for i in range(256)], dtype=np.uint64)
#: Places of a word whose weights are kept in a table.
_DEEP = 256

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        steps = np.full(m, base & _MASK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


_QI = pow(_Q, -1, 1 << 64)
_tables: dict[tuple[bool, bytes], np.ndarray] = {}
_ramps = [np.zeros(0, np.uint16)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads the low bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _weight(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """An arbitrary 64-bit value for each byte at each place of a word, without structure between places."""
    return mix(mix((place.astype(np.uint64) << np.uint64(8) | byte) + np.uint64(_Q)) + np.uint64(_R))


def _word_weights(lower: bool, space: np.ndarray) -> np.ndarray:
    """Weights of the first places, 256 for each; bytes that separate words weigh nothing."""
    key = (lower, space.tobytes())
    if key not in _tables:
        byte = LOWER if lower else np.arange(256, dtype=np.uint8)
        table = _weight(np.repeat(np.arange(_DEEP), 256), np.tile(byte, _DEEP))
        table[np.tile(space, _DEEP)] = 0
        _tables[key] = table
    return _tables[key]


def _ramp(n: int) -> np.ndarray:
    """0, 1, 2, ... modulo 2**16; kept and grown."""
    if len(_ramps[0]) < n:
        _ramps[0] = np.arange(max(n, CHUNK_BYTES + (1 << 16))).astype(np.uint16)
    return _ramps[0][:n]


class Chunk:
    """Some rows: the other columns as Arrow arrays, the texts as one byte array."""

    def __init__(self, batches: list[pa.RecordBatch], text: str = "text"):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.table = table
        col = table.column(text)
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
        if col.null_count:
            col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        self.n = len(col)
        self.offsets, self.data = _views(col)

    def column(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def carried(self, names: list[str]) -> list[pa.Array]:
        """Columns as they came."""
        return [self.table.column(x).combine_chunks() for x in names]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _views(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buffers = col.buffers()
    if len(col) == 0 or buffers[1] is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(buffers[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


_trim = _trimmer()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Regroup batches to runs of rows of about ``limit`` text bytes (a longer text is a run of its own)."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        n, r = batch.num_rows, 0
        if not n:
            continue
        off, _ = _views(batch.column(batch.schema.get_field_index(text)))
        while r < n:
            e = int(np.searchsorted(off, off[r] + limit - size, side="right")) - 1
            e = min(n, max(e, r if held else r + 1))
            if e > r:
                held.append(batch.slice(r, e - r))
                size += int(off[e] - off[r])
                rows += e - r
                r = e
            if r < n or size >= limit or rows >= 100_000:
                yield Chunk(held, text)
                held, size, rows = [], 0, 0
    if held:
        yield Chunk(held, text)
        held = []
    give_back()


class Tokens:
    """Words (runs of other than ASCII white space) of a chunk.

    ``first[d]`` to ``first[d + 1]`` are the words of document d.
    """

    def __init__(self, chunk: Chunk, lower: bool, space: np.ndarray | None = None):
        """``space``: which of the 256 bytes separate words, by default ASCII white space."""
        data, off = chunk.data, chunk.offsets
        space_of = SPACE if space is None else space
        n = len(data)
        if n == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(chunk.n + 1, np.int64)
            return
        space = space_of[data]
        edge = off[:-1][off[:-1] < n]
        begin = ~space
        begin[1:] &= space[:-1]
        begin[edge] = ~space[edge]
        self.start = np.flatnonzero(begin)
        last = ~space
        last[:-1] &= space[1:]
        tail = off[1:][off[1:] > 0] - 1
        last[tail] = ~space[tail]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(chunk.n), np.diff(self.first))
        if len(self.start):
            # a sum of one weight for each (place, byte): equal for equal words, and by chance alone for others
            head = int(self.start[0])
            start = self.start - head
            size = np.diff(np.append(start, n - head))
            data = data[head:]
            table = _word_weights(lower, space_of)
            if size.max() <= _DEEP:
                place = _ramp(n - head) - np.repeat(start.astype(np.uint16), size)
                w = table[(place << np.uint16(8)) | data]
            else:
                place = np.arange(n - head) - np.repeat(start, size)
                w = table[(np.minimum(place, _DEEP - 1) << 8) | data]
                deep = np.flatnonzero(place >= _DEEP)
                byte = LOWER[data[deep]] if lower else data[deep]
                w[deep] = np.where(space_of[data[deep]], np.uint64(0), _weight(place[deep], byte))
            self.hash = mix(np.add.reduceat(w, start))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (runs may cross documents: mask them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, out, at, size, block = 0, None, 0, 1, h
    while True:
        if k >> at & 1:
            part = block[done : done + len(h) - k + 1]
            out = part.copy() if out is None else out * np.uint64(pow(_R, size, 1 << 64)) + part
            done += size
        at += 1
        if k >> at == 0:
            return mix(out)
        block = block[:-size] * np.uint64(pow(_R, size, 1 << 64)) + block[size:]
        size *= 2


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k bytes."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    s = _BYTE[data]
    s *= powers(_Q, n)
    np.cumsum(s, out=s)
    g = s[k - 1 :].copy()
    g[1:] -= s[: n - k]
    g *= powers(_QI, n)[: n - k + 1]
    return mix(g)


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some run of w values, ties included.

    Which positions are chosen in a run depends on the run alone, so two equal
    runs have equal choices.  Values of ``NEVER`` are not chosen.
    """
    if len(h) == 0:
        return np.zeros(0, np.int64)
    order = (h >> np.uint64(32)).astype(np.uint32)
    order[h == NEVER] = 0xFFFFFFFF
    if len(order) < w:
        chosen = order == order.min()
    else:
        low = _slide(order, w, np.minimum)
        pad = np.zeros(w - 1, np.uint32)
        chosen = order == _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    chosen &= order != 0xFFFFFFFF
    return np.flatnonzero(chosen)


# ---------------------------------------------------------------- packed rows

def bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """Target partition of each hash: by its place in the range of all hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def encode(arrays: list[np.ndarray]) -> bytes:
    return b"".join([np.uint32(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def decode(blob: bytes | memoryview, kinds: list) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    out, at = [], 4
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


PACKED = "pid int, blob binary"


def packed(pid: np.ndarray, arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each target partition, with the arrays' values that go there."""
    if not len(pid):
        return
    order = np.argsort(pid, kind="stable")
    pid = pid[order]
    arrays = [a[order] for a in arrays]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(pid)) + 1, [len(pid)]])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(pid[cuts[:-1]], pa.int32()),
            pa.array([encode([a[s:e] for a in arrays]) for s, e in zip(cuts[:-1], cuts[1:])], pa.binary()),
        ],
        ["pid", "blob"],
    )


def unpacked(batches: Iterable[pa.RecordBatch], kinds: list, name: str = "blob") -> list[np.ndarray]:
    """All packed rows of a partition, put together."""
    parts = [decode(x.as_buffer(), kinds) for b in batches for x in b.column(b.schema.get_field_index(name)) if x.is_valid]
    if not parts:
        return [np.zeros(0, k) for k in kinds]
    give_back()
    return [np.concatenate(p) for p in zip(*parts)]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)
