"""Vectorised building blocks shared by the corpus operators (NumPy over Arrow batches, no Spark)."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
CACHE_BYTES = 40 << 20  # of spans known to a worker
TRIM_BYTES = 8 << 20  # texts after which a worker gives freed memory back
SLICE_BYTES = 1 << 21  # texts are worked on in slices of about this many bytes, so temporaries stay bounded


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply rounds); wraps modulo 2**64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LONG_SPAN = 512  # bytes beyond which a span is hashed or compared by itself, not with the others round by round


def _words(symbols: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Eight bytes from each symbol on as one number (a view), symbols in a number, and masks for the first 0, 1, ... of them."""
    size = symbols.itemsize
    padded = np.zeros(len(symbols) + 8, symbols.dtype)
    padded[: len(symbols)] = symbols
    per = 8 // size
    masks = np.array([(1 << (8 * size * k)) - 1 for k in range(per + 1)], U64)
    return np.ndarray((len(symbols) + 1,), "<u8", padded, strides=(size,)), per, masks


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end] for each span (symbols: uint8 or uint32). Words of eight bytes are mixed in one after
    the other, so no family of texts collides by construction; very long spans go through xxh3."""
    words, per, masks = _words(symbols)
    length = ends - starts
    acc = length.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D)
    most = LONG_SPAN // symbols.itemsize
    far = np.flatnonzero(length > most)
    todo = np.flatnonzero((length > 0) & (length <= most))
    at, left, own = starts[todo], length[todo], acc[todo]
    while len(todo):
        own ^= words[at] & masks[np.minimum(left, per)]
        own *= U64(0x9FB21C651E98DF25)
        own ^= own >> U64(29)
        more = left > per
        if more.all():
            at, left = at + per, left - per
            continue
        acc[todo] = own
        todo, at, left, own = todo[more], at[more] + per, left[more] - per, own[more]
    for i in far.tolist():
        acc[i] = xxhash.xxh3_64_intdigest(symbols[starts[i] : ends[i]].tobytes())
    return mix(acc)


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of `length` symbols of a and b are equal, symbol by symbol."""
    out = np.ones(len(length), bool)
    (x, per, masks), (y, _, _) = _words(a), _words(b)
    most = LONG_SPAN // a.itemsize
    todo = np.flatnonzero((length > 0) & (length <= most))
    i, j, left = a_starts[todo], b_starts[todo], length[todo]
    while len(todo):
        equal = (x[i] ^ y[j]) & masks[np.minimum(left, per)] == 0
        out[todo[~equal]] = False
        more = equal & (left > per)
        todo, i, j, left = todo[more], i[more] + per, j[more] + per, left[more] - per
    for k in np.flatnonzero(length > most).tolist():
        out[k] = np.array_equal(a[a_starts[k] : a_starts[k] + length[k]], b[b_starts[k] : b_starts[k] + length[k]])
    return out


def span_ids(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Numbers from 0 for spans: two spans have one number if, and only if, their symbols are equal."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = span_hashes(symbols, starts, ends) if hashes is None else hashes
    _, first, out = np.unique(hashes, return_index=True, return_inverse=True)
    length = ends - starts
    head = first[out]
    odd = np.flatnonzero((length != length[head]) | ~same_spans(symbols, starts, symbols, starts[head], np.minimum(length, length[head])))
    known: dict[bytes, int] = {}  # spans whose hash another one has too
    for i in odd.tolist():
        out[i] = known.setdefault(symbols[starts[i] : ends[i]].tobytes(), len(first) + len(known))
    return out


def window_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers for the windows of k neighbours of an array of ids: equal if, and only if, the windows are."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    top = int(ids.max()) + 1
    if top**k < 1 << 63:
        out = np.zeros(n, np.int64)
        for i in range(k):
            out = out * top + ids[i : n + i]
        return out
    out = ids[:n]
    for i in range(1, k):
        out = np.unique(out * top + ids[i : n + i], return_inverse=True)[1]
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and its offsets, as int64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows of about `most` text bytes (a longer text is a run of its own). Memory that the work
    on them has freed goes back to the system again and again, as the allocator would keep all of it."""
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            since += int(ends[to - 1] - base)
            if since >= TRIM_BYTES:
                trim()
                since = 0
            at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that are not white space, and each run's row; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of k words; with fewer than k words, the whole sequence as one if asked for."""
    count = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    n = len(word_hashes)
    if n >= k:
        acc = np.zeros(n - k + 1, U64)
        for i in range(k):
            acc = acc * U64(0x9FB21C651E98DF25) + word_hashes[i : n - k + 1 + i]
        full = rows[: n - k + 1] == rows[k - 1 :]
        out_rows, out = rows[: n - k + 1][full], mix(acc[full] + U64(k))
    else:
        out_rows, out = np.zeros(0, np.int64), np.zeros(0, U64)
    if whole_if_short:
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            at = np.concatenate([[0], np.cumsum(count)])
            extra = []
            for r in short:
                acc = 0
                for h in word_hashes[at[r] : at[r + 1]].tolist():
                    acc = (acc * 0x9FB21C651E98DF25 + h) & (2**64 - 1)
                extra.append((acc + int(count[r])) & (2**64 - 1))
            out_rows = np.concatenate([out_rows, short])
            out = np.concatenate([out, mix(np.array(extra, U64))])
    return out_rows, out


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text as (values, offsets), sorted within a text. A-Z count as a-z."""
    data, offsets = text_bytes(column)
    starts, ends, rows = words(data, offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n_rows + 1, np.int64)
    rows, hashes = shingles(span_hashes(LOWER[data], starts, ends), rows, n_rows, k)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int64)


class HashIndex:
    """From 64-bit hashes to small integers: open addressing in two arrays, looked up for whole arrays at once."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = self._slots(hashes)
        out = np.where(self.keys[slot] == hashes, self.values[slot], -1)
        todo = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            value = self.values[slot]
            hit = (self.keys[slot] == hashes[todo]) & (value >= 0)
            out[todo[hit]] = value[hit]
            more = ~hit & (value >= 0)
            todo, slot = todo[more], slot[more]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that are not there yet."""
        if 2 * (self.n + len(hashes)) > 1 << self.bits:
            old = self.values >= 0
            keys, vals = self.keys[old], self.values[old]
            while 2 * (self.n + len(hashes)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.n = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int64), 0
            self._put(keys, vals)
        self._put(hashes, values)

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        self.n += len(hashes)
        slot = self._slots(hashes)
        while len(hashes):
            free = self.values[slot] < 0
            _, first = np.unique(slot, return_index=True)
            here = np.zeros(len(slot), bool)
            here[first] = True
            here &= free
            self.keys[slot[here]], self.values[slot[here]] = hashes[here], values[here]
            rest = ~here
            hashes, values, slot = hashes[rest], values[rest], slot[rest]
            slot = (slot + 1) & mask


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths[:-1])
    step[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


_CLASSES: dict[str, np.ndarray] = {}


def code_point_table(name: str, of: Callable[[str], int]) -> np.ndarray:
    """of(character) for every code point, computed once a process."""
    if name not in _CLASSES:
        _CLASSES[name] = np.array([of(chr(i)) for i in range(0x110000)], np.uint8)
    return _CLASSES[name]


def letter_class(c: str) -> int:
    """1: letter, 2: number, 3: white space, 0: anything else."""
    kind = unicodedata.category(c)[0]
    if kind in "LN":
        return 1 if kind == "L" else 2
    return 3 if c in _WHITE else 0


# The code points with Unicode's White_Space property.
_WHITE = {chr(i) for i in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}

def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts as one string, its code points, and where each text begins (with the end as the last entry)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return joined, points, offsets


class SpanCache:
    """From spans of code points to small integers; `encode` says what new spans stand for and how many bytes it keeps for
    them. Found by hash, decided on the code points. Bounded: it is emptied beyond `most` bytes, which costs time, never results."""

    def __init__(self, encode: Callable[[list[str]], int], forget: Callable[[], None], most: int = CACHE_BYTES) -> None:
        self.encode, self.forget, self.most = encode, forget, most
        self.clear()

    def clear(self) -> None:
        self.forget()
        self.index, self.points, self.at, self.used, self.n, self.kept = HashIndex(14), np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64), 0, 0, 0

    def _store(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[str]) -> np.ndarray:
        """The numbers of new spans."""
        length = ends - starts
        self.points = grown(self.points, self.used + int(length.sum()))
        self.at = grown(self.at, self.n + len(starts) + 1)
        self.at[self.n + 1 : self.n + 1 + len(starts)] = self.used + np.cumsum(length)
        self.points[self.used : self.used + int(length.sum())] = points[ranges(starts, length)]
        out = np.arange(self.n, self.n + len(starts))
        self.used, self.n = self.used + int(length.sum()), self.n + len(starts)
        self.kept += self.encode(spans)
        return out

    def look_up(self, joined: str, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
        if self.kept + 4 * self.used + 24 * self.n > self.most:
            self.clear()
        cut = lambda at: [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        hashes = span_hashes(points, starts, ends)
        found = self.index.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            own = self._store(points, starts[at], ends[at], cut(at))
            self.index.add(new, own)
            found[missing] = own[back]
        length = ends - starts
        same = self.at[found + 1] - self.at[found] == length
        same[same] = same_spans(points, starts[same], self.points, self.at[found[same]], length[same])
        odd = np.flatnonzero(~same)
        if len(odd):  # one hash for two spans: the later one goes without it
            found[odd] = self._store(points, starts[odd], ends[odd], cut(odd))
        return found


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n values and as many more."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(2 * n - len(x), x.dtype)])


def release() -> None:
    """Gives memory that a task has freed back to the system, so idle Python workers stay small."""
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() after its last batch."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied
