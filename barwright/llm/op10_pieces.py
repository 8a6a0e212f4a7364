"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

A text becomes the model's normal form (a space before it, spaces as word marks) and is cut where no piece of the
vocabulary spans two neighbouring characters; merges never cross such a cut. Each distinct unit is encoded once: an
Aho-Corasick automaton gives the longest piece at each position, a piece may follow another only if re-merging the two
yields just these two, and a bitfield marks positions from which no valid rest exists, so the search never repeats a failure.
Characters outside the vocabulary become byte pieces. Decoding goes from ids alone.

Defined results: null or empty text has only the end id and decodes to ""; repeated rows repeat their result; a null
doc_id stays null; an empty table gives an empty result; extra columns are ignored. Texts are worked on in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K

MARK = "▁"  # fixed value: the sign that stands for a space in pieces
PAIRS = 500_000  # compatibility results kept at most
UNIT_BYTES = 160 << 20  # of units known to a worker, with their ids and texts


@lru_cache(2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


class PieceModel:
    """Vocabulary and algorithms of one model file. Inside, the word mark is a plain space."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        source = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.text: dict[int, str] = {}
        self.end, self.unknown = source.eos_id(), source.unk_id()
        for i in range(source.get_piece_size()):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
            elif not (source.is_control(i) or source.is_unknown(i) or source.is_unused(i)):
                self.ids[piece.replace(MARK, " ")] = i
                self.text[i] = piece.replace(MARK, " ")
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.score = {p: source.get_score(i) for p, i in self.ids.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        chars = sorted({c for p in self.ids for c in p})
        self.char_class = np.zeros(0x110000, np.uint16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joint = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            c = self.char_class[[ord(x) for x in p]]
            self.joint[c[:-1], c[1:]] = True
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        good = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        for p in good:
            self.automaton.add_word(p, p)
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in good), None)
        self.automaton.make_automaton()
        self.cache = K.SpanCache(self._units, self._forget, UNIT_BYTES)

    def _forget(self) -> None:
        self.said: list[bytes] = []
        self.back: list[str] = []
        self.sizes = np.zeros(1 << 12, np.int64)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals. For short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces of a unit, by backtracking; a character outside the vocabulary is a piece of its own."""
        if len(unit) == 1:
            return [unit]
        n = len(unit)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(unit):
            start = end - len(piece) + 1
            if longest[start] is None or len(longest[start]) < len(piece):
                longest[start] = piece
        for i, piece in enumerate(longest):
            if piece is None:
                longest[i] = unit[i]
        alive = bytearray(b"\xff") * (n // 8 + 1)  # bit i: no failure known for the rest from i
        out: list[str] = []
        at, piece = 0, longest[0]
        while piece is not None:
            end = at + len(piece)
            if alive[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < n else None
                continue
            piece = self.shorter.get(piece)
            if piece is None:
                alive[at >> 3] &= ~(1 << (at & 7)) & 255
                if not out:
                    raise AssertionError(f"no valid split of {unit!r}")
                piece = out.pop()
                at -= len(piece)
        return out

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for p in self.split(unit):
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids with no leading space removed; control ids are empty, invalid bytes U+FFFD."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text.get(i, ""))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def _units(self, units: list[str]) -> int:
        got = [self.unit_ids(u) for u in units]
        n = len(self.said)
        said, back = [b" ".join(b"%d" % i for i in g) for g in got], list(map(self.decode, got))
        self.said += said
        self.back += back
        self.sizes = K.grown(self.sizes, n + len(got))
        self.sizes[n : n + len(got)] = [len(g) for g in got]
        return sum(map(len, said)) + 4 * sum(map(len, back)) + 150 * len(got)

    def encode(self, text: str) -> list[int]:
        """All ids of one text, the end id last."""
        ids, _, _ = self.encode_all([text])[0]
        return [int(i) for i in ids.split()]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """For each text: its ids in decimal joined by a space, the decoded text, and the number of ids."""
        joined, points, offsets = K.code_points([" " + t.replace(MARK, " ") if t else "" for t in texts])
        out = []
        if len(points):
            kind = self.char_class[points]
            begin = np.ones(len(points) + 1, bool)
            begin[1:-1] = ~self.joint[kind[:-1], kind[1:]]
            begin[offsets] = True
            starts = np.flatnonzero(begin)
            found = self.cache.look_up(joined, starts[:-1], starts[1:], points)
            sums = np.concatenate([[0], np.cumsum(self.sizes[found])])
            cuts = np.searchsorted(starts, offsets)
            sizes = (sums[cuts[1:]] - sums[cuts[:-1]]).tolist()
            units, cuts = found.tolist(), cuts.tolist()
            said, back, end = self.said, self.back, b"%d" % self.end
            for i, size in enumerate(sizes):
                own = units[cuts[i] : cuts[i + 1]]
                text = "".join([back[u] for u in own])
                out.append((b" ".join([*[said[u] for u in own], end]), text[1:] if text[:1] == " " else text, size + 1))
        else:
            out = [(b"%d" % self.end, "", 1)] * len(texts)
        return out


def _digests(path: str):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in K.slices(batches):
            got = model.encode_all([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, _, n in got], pa.int64()), pa.array([sha(i) for i, _, _ in got]), pa.array([sha(t.encode()) for _, t, _ in got])], names)

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in K.slices(batches):
            got = model.encode_all([t or "" for t in batch.column(1).to_pylist()])
            ids = pa.array([np.fromstring(i.decode(), np.int32, sep=" ") for i, _, _ in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts = [model.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())], ["doc_id", "text"])

    return run


def _rows(docs: DataFrame, what: str, kind: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(what).cast(kind).alias(what))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int, the end id last). path: the model's file."""
    return _rows(docs, "text", "string").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids (null: empty)."""
    return _rows(encoded, "ids", "array<int>").mapInArrow(_texts(path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded."""
    return _rows(docs, "text", "string").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
