"""Packing documents into sequences by minimum bin slack.

Documents become token ids (a public byte-level BPE; id 1 ends each); whole windows of a document are sequences of their
own. What remains of each document is packed: a window starts with the longest remainder, then a bitset subset-sum over
the multiset of remaining lengths (counts split in binary) finds the multiset that fills it closest to capacity, and is
read back from the saved bitsets. If slack is left while remainders wait, one is cut to fill it. What is left at the end of
a partition fills sequences whose sizes are powers of two, which need no padding.

Scale: packing runs inside each input partition as it streams (a pool of bounded size), so nothing is shuffled and no task
holds more than the pool; sequence ids carry the partition's number. A partition that is run again gives the same rows.

Defined results: null or empty text is one token (the end id); repeated rows are packed as often as they stand; a null
doc_id stays null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K

CAPACITY = 2048
END_ID = 1
POOL = 4096  # remainders that wait at most; packing then goes on until a quarter is left

_SUFFIXES = ("re", "ve", "ll"), ("s", "t", "m", "d")  # fixed values: contractions that are tokens of their own


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: runs of letters, numbers or other signs, each with one space before it; white space."""
    n = len(points)
    kind = K.code_point_table("letters", K.letter_class)[points]
    begin = np.ones(n + 1, bool)
    begin[1:n] = kind[1:] != kind[:-1]
    begin[offsets] = True
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets[1:]] = True
    runs = np.flatnonzero(begin)
    begins, ends = runs[:-1], runs[1:]
    out = begin[:n].copy()
    # the last character of white space before other text goes with that text if it is a space, else stands alone
    gaps = (kind[begins] == 3) & ~doc_end[ends]
    last, after = ends[gaps] - 1, ends[gaps]
    out[last] = True
    out[after[points[last] == 32]] = False
    # contractions: an apostrophe alone, not after a space, before fitting letters
    quote = begins[(ends - begins == 1) & (points[begins] == 39) & out[begins] & ~doc_end[ends]]
    if len(quote):
        quote = quote[kind[quote + 1] == 1]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one = np.isin(padded[quote + 1], [ord(c) for c in _SUFFIXES[1]])
        same = (kind[np.minimum(quote + 2, n - 1)] == 1) & (quote + 2 < n) & ~doc_end[quote + 2]
        two = same & np.isin(padded[quote + 1] * 256 + padded[quote + 2], [ord(a) * 256 + ord(b) for a, b in _SUFFIXES[0]]) & (padded[quote + 1] < 256) & (padded[quote + 2] < 256)
        for which, k in ((one, 1), (two & ~one, 2)):
            at = quote[which]
            out[at + 1] = False
            follow = at + 1 + k
            out[follow[follow < n]] = True
    return np.flatnonzero(out)


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Ids of texts: new pre-tokens are merged once, known ones come from a bounded cache."""

    def __init__(self, path: str) -> None:
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.fast = self._fast(parts["model"])
        self.cache = K.SpanCache(self._encode, self._forget)

    @property
    def tokenizer(self):
        """The tokenizers library's object; only texts with control strings need it."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _forget(self) -> None:
        self.flat, self.at, self.n, self.used = np.zeros(1 << 14, np.uint32), np.zeros(1 << 12, np.int64), 0, 0

    def _fast(self, model: dict):
        """tiktoken's merge loop over this file's vocabulary, several times faster on single pre-tokens; None unless the
        file's merges are in the order of the ids, which makes both libraries' merges the same."""
        import tiktoken

        chars = _byte_characters()
        special = set(self.special)
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or not all(set(t) <= chars.keys() for t in model["vocab"] if t not in special):
            return None
        vocab = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        made = [vocab[bytes(chars[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made) or len(vocab) != 256 + len(set(made)):
            return None
        coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})
        coder._mergeable_ranks = {}  # the merge loop has its own copy
        return coder._encode_single_piece

    def _encode(self, spans: list[str]) -> int:
        if self.fast:
            got = [self.fast(t) for t in spans]
        else:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(spans, add_special_tokens=False)]
        sizes = np.array([len(g) for g in got], np.int64)
        total = int(sizes.sum())
        self.flat, self.at = K.grown(self.flat, self.used + total), K.grown(self.at, self.n + len(got) + 1)
        self.flat[self.used : self.used + total] = np.fromiter((i for g in got for i in g), np.uint32, total)
        self.at[self.n + 1 : self.n + 1 + len(got)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + total, self.n + len(got)
        return 4 * total + 8 * len(got)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END_ID, and where each text's begin."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        joined, points, offsets = K.code_points(plain)
        if len(points):
            starts = pre_tokens(points, offsets)
            tokens = self.cache.look_up(joined, starts, np.append(starts[1:], len(points)), points)
            sizes = self.at[tokens + 1] - self.at[tokens]
            flat = self.flat[K.ranges(self.at[tokens], sizes)]
            total = np.concatenate([[0], np.cumsum(sizes)])
            cuts = total[np.searchsorted(starts, offsets)]
        else:
            flat, cuts = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if odd:  # a control token's string in a text: the library's own reading of the whole text
            parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else flat[cuts[i] : cuts[i + 1]] for i, t in enumerate(texts)]
            flat, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        flat = np.insert(flat, cuts[1:], np.uint32(END_ID))
        return flat, cuts + np.arange(len(texts) + 1)


def best_fill(waiting: dict[int, list], order: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (length: count) whose sum is closest to room from below. order: the lengths, ascending."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for i in range(bisect_right(order, room) - 1, -1, -1):
        length = order[i]
        have = min(len(waiting[length]), room // length)
        part = 1
        while have > 0:
            take = min(part, have)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            have -= take
            part *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


class Packer:
    """Packs remainders as they come. A piece: (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, pool: int = POOL) -> None:
        self.next, self.capacity, self.most = first_id, capacity, pool
        self.waiting: dict[int, list] = {}
        self.order: list[int] = []
        self.n, self.tokens = 0, 0
        self.out: list[tuple] = []

    def _emit(self, piece: tuple, offset: int) -> int:
        doc, start, ids, total = piece
        self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
        return offset + len(ids)

    def _put(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.waiting:
            self.waiting[length] = []
            insort(self.order, length)
        self.waiting[length].append(piece)
        self.n += 1
        self.tokens += len(piece[2])

    def _take(self, length: int) -> tuple:
        stack = self.waiting[length]
        piece = stack.pop()
        if not stack:
            del self.waiting[length]
            del self.order[bisect_left(self.order, length)]
        self.n -= 1
        self.tokens -= length
        return piece

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._emit((doc, start, ids[start : start + self.capacity], total), 0)
            self.next += 1
            start += self.capacity
        if start < total:
            self._put((doc, start, ids[start:].copy(), total))
        if self.n > self.most:
            while self.n > self.most // 4:
                self._window(self.capacity)

    def _window(self, capacity: int) -> None:
        """One sequence of exactly `capacity` tokens, or of all that waits."""
        offset = 0
        if self.order and self.order[0] <= capacity:
            offset = self._emit(self._take(self.order[bisect_right(self.order, capacity) - 1]), 0)
            for length, times in best_fill(self.waiting, self.order, capacity - offset).items():
                for _ in range(times):
                    offset = self._emit(self._take(length), offset)
        if offset < capacity and self.waiting:  # cut one that waits
            doc, start, ids, total = self._take(self.order[-1])
            room = min(capacity - offset, len(ids))
            offset = self._emit((doc, start, ids[:room], total), offset)
            if room < len(ids):
                self._put((doc, start + room, ids[room:], total))
            elif offset < capacity:
                raise AssertionError("a remainder that fitted was left out")
        self.next += 1

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self._window(self.capacity)
        while self.tokens:
            self._window(1 << (self.tokens.bit_length() - 1))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pack(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder, packer = _encoder(path), Packer((context.partitionId() if context else 0) << 32, capacity)

        def rows() -> pa.RecordBatch:
            done, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in K.slices(batches):
            ids, at = encoder.ids([t or "" for t in batch.column(1).to_pylist()])
            for i, doc in enumerate(batch.column(0).to_pylist()):
                packer.add(doc, ids[at[i] : at[i + 1]])
            if packer.out:
                yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    return K.tidy(run)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: the tokenizer's file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(path, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
