"""Removal of repeated passages by longest-previous-factor arrays: every byte covered by a 50-byte string that also starts in a
document with a smaller id goes; the first document keeps it.

A suffix goes when its longest previous factor, the longest match with a suffix of an earlier document, has 50 bytes or more.
Suffix order puts its best matches next to it: they are at the previous and at the next smaller position (here: document), and
the factor's length is the smallest common prefix on the way there. So suffixes are put in order of their first 50 bytes, in
groups that hold all suffixes that can match:

1. Documents are packed into chunks of a few MB, written once in buckets by chunk, so that later joins leave them in place.
2. Each 50-byte string has an anchor, its smallest k-gram hash; neighbours mostly share it, so a chunk has about one anchor for
   sixteen bytes. Chunks send 4 bytes an anchor, packed by anchor bucket, and learn which anchors other chunks have too.
3. Runs of strings with such anchors go, once a chunk for equal runs, with their bytes to the anchor's bucket. There the suffix
   array, the common prefixes of neighbours, and the previous and next smaller documents give the strings that start earlier
   elsewhere; a bit for each goes back. Anchors with very many runs are dealt by the whole string instead, so that no group
   grows with one frequent phrase.
4. Chunks turn the bits into removed spans.

Nothing is collected to the driver or broadcast. Hashes choose what is compared (false alarms are harmless) and fold equal runs
of up to 81 bytes (64 bits, then compared byte by byte); matches are decided on bytes. The bucketed table has at most BUCKETS
buckets, so one that outgrows BUCKETS chunks has more chunks a bucket, which tasks read one after the other.

Defined results: null or empty text has no bytes; rows with equal doc_id never remove from each other; a null doc_id comes
after all others; texts under 50 bytes stay; an empty table gives an empty result; extra columns are ignored by digests() and
kept by remove_repeats(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K
from barwright.llm.store import saved, saved_in_buckets

LENGTH = 50
GRAM = 20
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20  # text bytes for each anchor bucket
BUCKETS = 20_000  # of the table of chunks, at most
HOT = 100_000  # runs of one anchor beyond which its strings are dealt one by one
NO_ID = np.iinfo(np.int64).max
_MAX_RUN = LENGTH - GRAM + 1
_PACK = pa.Codec("zstd", 1)


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring 50-byte strings with one anchor: first start, number of strings, anchor hash, row."""
    parts = []
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
        parts.append(_slice_runs(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], offsets[at], at))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on, mixed from three words of eight bytes that cover them."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    n = len(data) - GRAM + 1
    out = words[:n] * np.uint64(0x9FB21C651E98DF25)
    for at in (8, GRAM - 8):
        out ^= out >> np.uint64(29)
        out ^= words[at : at + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _slice_runs(data: np.ndarray, offsets: np.ndarray, base: int, first_row: int):
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n <= 0:
        return none
    low = _gram_hashes(data)
    width = 1
    while 2 * width <= _MAX_RUN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (_MAX_RUN - width)], low[_MAX_RUN - width :])
    valid = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    begin = valid.copy()
    begin[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none
    stop = valid.copy()
    stop[:-1] &= begin[1:] | ~valid[1:]
    sizes = np.flatnonzero(stop) + 1 - starts
    keys = low[starts]
    if sizes.max() > _MAX_RUN:  # repetitive text: runs are cut, counted from their start
        pieces = -(-sizes // _MAX_RUN)
        nth = K.ranges(np.zeros(len(sizes), np.int64), pieces)
        starts, keys, whole = np.repeat(starts, pieces) + nth * _MAX_RUN, np.repeat(keys, pieces), np.repeat(sizes, pieces)
        sizes = np.minimum(_MAX_RUN, whole - nth * _MAX_RUN)
    return starts + base, sizes, keys, np.searchsorted(offsets, starts, side="right") - 1 + first_row


def _pack_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    chunk, rows, size = (context.partitionId() if context else 0) << 24, [], 0

    def out() -> pa.RecordBatch:
        data, offsets = K.text_bytes(pa.chunked_array([b.column(1) for b in rows]).combine_chunks())
        ids = pa.chunked_array([b.column(0) for b in rows]).combine_chunks()
        known = np.asarray(ids.is_valid())
        rest = pa.Table.from_batches([b.select(b.schema.names[2:]) for b in rows])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as stream:
            stream.write_table(rest)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (np.asarray(ids.fill_null(NO_ID), np.int64), known, offsets, data)), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["chunk", "ids", "known", "offsets", "data", "rest"],
        )

    for batch in K.slices(batches, "text", min(1 << 20, chunk_bytes)):
        rows.append(batch)
        size += int(pc.sum(pc.binary_length(batch.column(1))).as_py() or 0)
        if size >= chunk_bytes:
            yield out()
            chunk, rows, size = chunk + 1, [], 0
    if rows:
        yield out()


class Chunk:
    """A chunk's arrays, its anchors in order of bucket, and after marks are known its runs to be compared."""

    def __init__(self, row: dict, buckets: int) -> None:
        self.number, self.buckets = row["chunk"], buckets
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.offsets, self.data = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["data"], np.uint8)
        self.starts, self.sizes, keys, self.rows = anchor_runs(self.data, self.offsets)
        anchors, self.anchor_of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.bucket_of = self.bucket(anchors)
        self.order = np.lexsort((anchors, self.bucket_of))
        self.anchors, self.counts = anchors, counts

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def by_bucket(self, buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of an array that is sorted by bucket."""
        if len(buckets):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield int(buckets[a]), a, b

    def anchor_rows(self) -> Iterator[tuple]:
        keys = (self.anchors[self.order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        counts = np.minimum(self.counts[self.order], 65535).astype(np.uint16)
        for bucket, a, b in self.by_bucket(self.bucket_of[self.order]):
            yield bucket, self.number, keys[a:b].tobytes(), counts[a:b].tobytes()

    def compare(self, marks: list[dict] | None) -> None:
        """Chooses the runs to be compared. marks: (bucket, state of each anchor: 0, 1 known elsewhere, 2 very many)."""
        state = np.zeros(len(self.anchors), np.uint8)
        got = {m["bucket"]: m["state"] for m in marks or []}
        for bucket, a, b in self.by_bucket(self.bucket_of[self.order]):
            if bucket in got:
                state[self.order[a:b]] = np.frombuffer(got[bucket], np.uint8)
        docs = self.ids[self.rows]
        if len(docs):
            first = np.full(len(self.anchors), NO_ID)
            np.minimum.at(first, self.anchor_of, docs)
            last = np.full(len(self.anchors), np.iinfo(np.int64).min)
            np.maximum.at(last, self.anchor_of, docs)
            state = np.maximum(state, (last > first).astype(np.uint8))
        own = state[self.anchor_of] if len(self.anchor_of) else np.zeros(0, np.uint8)
        few, many = own == 1, own == 2
        size = self.sizes[many]
        starts = np.concatenate([self.starts[few], K.ranges(self.starts[many], size)])
        sizes = np.concatenate([self.sizes[few], np.ones(int(size.sum()), np.int64)])
        docs = np.concatenate([docs[few], np.repeat(docs[many], size)])
        hashes = K.span_hashes(self.data, starts, starts + sizes + LENGTH - 1)
        anchor_bucket = self.bucket_of[self.anchor_of[few]] if len(self.anchor_of) else np.zeros(0, np.int64)
        buckets = np.concatenate([anchor_bucket, self.bucket(hashes[len(anchor_bucket) :])])
        order = np.lexsort((docs, hashes, buckets))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (buckets[order][1:] != buckets[order][:-1]) | ~_equal_neighbours(self.data, starts[order], sizes[order])
        self.run_starts, self.run_sizes, self.run_docs = starts[order], sizes[order], docs[order]
        self.group = np.cumsum(new) - 1  # equal runs; the first has the smallest document
        self.heads = np.flatnonzero(new)
        self.head_buckets = buckets[order][self.heads]

    def run_rows(self) -> Iterator[tuple]:
        starts, sizes, docs = self.run_starts[self.heads], self.run_sizes[self.heads], self.run_docs[self.heads]
        for bucket, a, b in self.by_bucket(self.head_buckets):
            content = self.data[K.ranges(starts[a:b], sizes[a:b] + LENGTH - 1)]
            yield bucket, self.number, docs[a:b].tobytes(), sizes[a:b].astype(np.uint8).tobytes(), _PACK.compress(content).to_pybytes()

    def removed(self, masks: list[dict] | None) -> np.ndarray:
        """For each byte of the chunk, whether it goes."""
        bits = np.zeros(len(self.heads), np.uint64)
        got = {m["bucket"]: m["bits"] for m in masks or []}
        for bucket, a, b in self.by_bucket(self.head_buckets):
            if bucket in got:
                bits[a:b] = np.frombuffer(got[bucket], np.uint64)
        cover = np.zeros(len(self.data) + 1, np.int32)
        if len(self.run_starts):
            later = self.run_docs > self.run_docs[self.heads][self.group]
            position = K.ranges(self.run_starts, self.run_sizes)
            nth = (position - np.repeat(self.run_starts, self.run_sizes)).astype(np.uint64)
            hit = np.repeat(later, self.run_sizes) | ((np.repeat(bits[self.group], self.run_sizes) >> nth) & np.uint64(1)).astype(bool)
            np.add.at(cover, position[hit], 1)
            np.add.at(cover, position[hit] + LENGTH, -1)
        return np.cumsum(cover[:-1]) > 0


def _anchor_states(frame: pd.DataFrame, hot: int = HOT) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(b, np.uint32) for b in frame["keys"]])
    counts = np.concatenate([np.frombuffer(b, np.uint16) for b in frame["counts"]]).astype(np.int64)
    _, inverse, chunks = np.unique(keys, return_inverse=True, return_counts=True)
    runs = np.bincount(inverse, counts)
    state = ((chunks > 1).astype(np.uint8) + ((chunks > 1) & (runs > hot)).astype(np.uint8))[inverse]
    cuts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in frame["keys"]])])
    keep = [i for i in range(len(frame)) if state[cuts[i] : cuts[i + 1]].any()]
    return pd.DataFrame({"chunk": frame["chunk"].to_numpy()[keep], "bucket": frame["bucket"].to_numpy()[keep], "state": [state[cuts[i] : cuts[i + 1]].tobytes() for i in keep]})


def _equal_neighbours(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run but the first, whether it has the bytes of the one before."""
    if not len(starts):
        return np.zeros(0, bool)
    return (sizes[1:] == sizes[:-1]) & K.same_spans(data, starts[1:], data, starts[:-1], np.minimum(sizes[1:], sizes[:-1]) + LENGTH - 1)


def suffix_array(content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first LENGTH bytes, and whether each shares them with the one before it.

    Common prefixes are cut at LENGTH: all that is asked of them is whether they reach it."""
    padded = np.zeros(len(content) + LENGTH, np.uint8)
    padded[: len(content)] = content
    heads = np.ndarray((len(content),), f"S{LENGTH}", padded, strides=(1,))[starts]
    order = np.argsort(heads)
    heads = heads[order]
    common = np.zeros(len(order), bool)
    common[1:] = heads[1:] == heads[:-1]
    return order, common


def _nearest_smaller(common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix, the nearest one before it, among those that share LENGTH bytes with it, of a smaller document; -1 if
    none. Pointers that lead to a document that is no smaller take over where that one's pointer leads, all at once."""
    at = np.where(common, np.arange(len(docs)) - 1, -1)
    todo = np.flatnonzero(common)
    while len(todo):
        todo = todo[docs[at[todo]] >= docs[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def has_previous_factor(common: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, whether its longest previous factor reaches LENGTH: whether the previous or the next
    smaller document in suffix order shares that many bytes."""
    before = _nearest_smaller(common, docs) >= 0
    turned = np.zeros(len(common), bool)
    turned[1:] = common[1:][::-1]
    return before | (_nearest_smaller(turned, docs[::-1]) >= 0)[::-1]


def earlier_starts(content: np.ndarray, first: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each run, a bit for each of its strings: whether it also starts in a document with a smaller id.

    content: the runs' bytes; first: where each begins."""
    start = K.ranges(first, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    order, common = suffix_array(content, start)
    hit = np.zeros(len(order), np.uint64)
    hit[order] = has_previous_factor(common, docs[run[order]])
    return np.bitwise_or.reduceat(hit << (start - first[run]).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _run_masks(frame: pd.DataFrame) -> pd.DataFrame:
    docs = np.concatenate([np.frombuffer(b, np.int64) for b in frame["docs"]])
    sizes = np.concatenate([np.frombuffer(b, np.uint8) for b in frame["sizes"]]).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum([len(b) for b in frame["sizes"]])])
    bytes_of = np.add.reduceat(sizes + LENGTH - 1, cuts[:-1]).tolist()
    content = np.concatenate([np.frombuffer(_PACK.decompress(b, n), np.uint8) for b, n in zip(frame["content"], bytes_of, strict=True)])
    first = np.concatenate([[0], np.cumsum(sizes + LENGTH - 1)[:-1]])
    # equal runs of several chunks are compared once, as those of the smallest document
    hashes = K.span_hashes(content, first, first + sizes + LENGTH - 1)
    order = np.lexsort((docs, hashes))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | ~_equal_neighbours(content, first[order], sizes[order])])
    head = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    bits = earlier_starts(content, first[head], sizes[head], docs[head])[group]
    whole = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    bits = np.where(docs > docs[head][group], whole, bits)
    K.trim()
    keep = [i for i in range(len(frame)) if bits[cuts[i] : cuts[i + 1]].any()]
    return pd.DataFrame({"chunk": frame["chunk"].to_numpy()[keep], "bucket": frame["bucket"].to_numpy()[keep], "bits": [bits[cuts[i] : cuts[i + 1]].tobytes() for i in keep]})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            out = list(Chunk(row, buckets).anchor_rows())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "keys", "counts"])

    return run


def _send_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, buckets)
            chunk.compare(row["marks"])
            out = list(chunk.run_rows())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "docs", "sizes", "content"])

    return run


def _finish(buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, buckets)
            chunk.compare(row["marks"])
            gone = chunk.removed(row["masks"])
            at = chunk.offsets
            if with_text:
                gone = _whole_characters(chunk.data, gone)
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            firsts = at[:-1][np.diff(at) > 0]
            begin[firsts] = gone[firsts]
            spans = np.concatenate([[0], np.cumsum(begin)])
            kept = chunk.data[~gone].tobytes()
            kept_at = (at - total[at]).tolist()
            texts = [kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
            ids = pa.array(chunk.ids, mask=~chunk.known)
            if with_text:
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((total[at[1:]] - total[at[:-1]]), pa.int64()), pa.array([t.decode() for t in texts], pa.string())], [*rest.column_names, "n_removed", "kept_text"])
            else:
                sums = [np.diff(at), total[at[1:]] - total[at[:-1]], spans[at[1:]] - spans[at[:-1]]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(s, pa.int64()) for s in sums), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Characters go only if all of their bytes do."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return gone
    return np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data))))


def _found(docs: DataFrame, with_text: bool, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, most: int = BUCKETS) -> DataFrame:
    others = [c for c in docs.columns if c != "text"] if with_text else []
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)]  # no name of theirs can clash
    base = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"), *own)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket_bytes))
    chunks = base.mapInArrow(K.tidy(lambda batches: _pack_chunks(batches, chunk_bytes)), "chunk long, ids binary, known binary, offsets binary, data binary, rest binary")
    chunks = saved_in_buckets(chunks, "chunk", min(most, max(12, -(-total // (6 * chunk_bytes)))))
    bare = chunks.drop("rest")
    anchors = bare.mapInArrow(K.tidy(_send_anchors(buckets)), "bucket long, chunk long, keys binary, counts binary")
    states = anchors.groupBy("bucket").applyInPandas(lambda frame: _anchor_states(frame, hot), "chunk long, bucket long, state binary")
    marks = saved(states.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "state")).alias("marks")))
    marked = bare.join(marks, "chunk", "left")
    runs = marked.mapInArrow(K.tidy(_send_runs(buckets)), "bucket long, chunk long, docs binary, sizes binary, content binary")
    bits = runs.groupBy("bucket").applyInPandas(_run_masks, "chunk long, bucket long, bits binary")
    masks = saved(bits.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("masks")))
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in base.select(*(f"__c{i}" for i in range(len(others)))).schema.fields)
    result = f"{kept}n_removed long, kept_text string" if with_text else "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (chunks if with_text else bare).join(marks, "chunk", "left").join(masks, "chunk", "left").mapInArrow(K.tidy(_finish(buckets, with_text)), result)


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return _found(docs, False, **sizes)


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs with the text that stays; a character whose bytes would go in part stays whole. Other columns stay as they are."""
    out = _found(docs, True, **sizes)
    names = iter(range(len(docs.columns)))
    return out.select(*(F.col("kept_text" if c == "text" else f"__c{next(names)}").alias(c) for c in docs.columns))
