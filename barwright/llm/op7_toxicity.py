"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding takes characters apart (ligatures, accents), drops combining marks and signs without width, maps letters to lower
case, look-alike letters of other scripts and digits or signs that stand for letters to the plain letter, and everything else
to a space. The lexicon holds whole words and word beginnings, learnt from labelled rows: the weight of a term is the lower
confidence bound of its log-odds between toxic and other documents, and every term with enough support and weight is in it.
A text's weight is the sum over its words of the best match; words inside a phrase of exception count nothing. Such phrases
are a few fixed ones, and pairs of neighbouring words, one of them in the lexicon, that the labelled rows show to be harmless.
Weight and weight by length go through a logistic curve fitted to the same rows.

The lexicon is learnt from at most SAMPLE labelled texts (the smallest by hash; the bound makes the broadcast of their ids
safe); every document is scored whole. Without labelled rows of both kinds scores are 0.

Defined results: null or empty text is scored like a text without matches; repeated label rows count once (toxic if one
says so), as do repeated texts; label rows without a document count for nothing; a null doc_id is scored too (never held
out); an empty table gives an empty result; labels, lang, source and doc_id are no inputs; other columns stay as they are.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K
from barwright.llm.sampling import smallest
from barwright.llm.store import Tables

SAMPLE = 20_000  # labelled texts, at most, from which lexicon and curve are learnt
SUPPORT = 3  # toxic documents in which a term must stand
LEAST = 1.5  # lower bound of a term's log-odds
Z = 1.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3

# Signs that look like letters.
LOOKS_LIKE = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i",
}

# Phrases, folded, in which a word of the lexicon is not meant as an insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clownfish", "idiot proof", "moron test", "pond scum", "soap scum", "sore loser", "not stupid", "not worthless")


_MANY = 0xFFFFFFFF  # in the table: the character folds to more than one


def _fold_char(c: str) -> str:
    out = []
    for part in unicodedata.normalize("NFKD", LOOKS_LIKE.get(c, c)):
        for low in LOOKS_LIKE.get(part, part).lower():
            low = LOOKS_LIKE.get(low, low)
            kind = unicodedata.category(low)
            if kind[0] == "L":
                out.append(low)
            elif kind[0] != "M" and kind != "Cf":
                out.append(" ")
    return "".join(out)


@lru_cache(1)
def _fold_table() -> tuple[np.ndarray, dict[int, str]]:
    """The folded code point of each (0: dropped), and the strings of those that fold to more than one."""
    table, many = np.full(0x110000, 32, np.uint32), {}
    for i in (*range(0x32400), *range(0xE0000, 0xE0200)):  # the rest is unassigned or private: no letters
        folded = " " if 0xD800 <= i < 0xE000 else _fold_char(chr(i))
        if len(folded) > 1:
            many[i] = folded
        table[i] = _MANY if len(folded) > 1 else ord(folded) if folded else 0
    return table, many


def fold(texts: list[str]) -> list[str]:
    """Each text folded, with a space before and after."""
    if not texts:
        return []
    table, many = _fold_table()
    _, points, offsets = K.code_points([f" {t} " for t in texts])
    folded = table[points]
    if (folded == _MANY).any():
        _, points, offsets = K.code_points([f" {t.translate(many)} " for t in texts])
        folded = table[points]
    stays = folded != 0
    at = np.concatenate([[0], np.cumsum(stays)])[offsets].tolist()
    joined = folded[stays].tobytes().decode("utf-32-le")
    return [joined[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def terms_of(folded: str) -> set[str]:
    """Whole words (' word ') and word beginnings (' wor') of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


@dataclass(frozen=True)
class Model:
    """terms: folded term to weight; curve: intercept and slopes of the logistic fit, None for no fit."""

    terms: tuple[tuple[str, float], ...]
    curve: tuple[float, float, float] | None
    exceptions: tuple[str, ...] = EXCEPTIONS


@lru_cache(2)
def _automaton(model: Model):
    import ahocorasick

    out = ahocorasick.Automaton()
    for t, w in model.terms:
        out.add_word(t, (len(t), w))
    for e in model.exceptions:
        out.add_word(f" {e} ", (len(e) + 2, -1.0))
    out.make_automaton()
    return out


def weigh(folded: str, automaton) -> tuple[float, int]:
    """The summed weight of a folded text and its number of words."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight < 0:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in spared)}
    return sum(best.values()), len(folded.split())


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float] | None:
    """Logistic regression with a small ridge on the slopes, by Newton steps."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    x, beta, penalty = features(weight, words), np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (toxic - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        seen, bad = Counter(), Counter()
        for text, toxic in zip(fold([t or "" for t in batch.column(0).to_pylist()]), batch.column(1).to_pylist(), strict=True):
            found = terms_of(text)
            (bad if toxic else seen).update(found)
        yield _counts(seen, bad)


def _count_phrases(lexicon: frozenset[str]):
    """Pairs of neighbouring words, one of them in the lexicon, by the texts that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            seen, bad = Counter(), Counter()
            for text, toxic in zip(fold([t or "" for t in batch.column(0).to_pylist()]), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                hit = [_known(w, lexicon) for w in words]
                (bad if toxic else seen).update({f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y})
            yield _counts(seen, bad)

    return run


def _known(word: str, lexicon: frozenset[str]) -> bool:
    return f" {word} " in lexicon or any(f" {word[:k]}" in lexicon for k in PREFIXES if len(word) >= k)


def _counts(good: Counter, bad: Counter) -> pa.RecordBatch:
    names = list(good.keys() | bad.keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())], ["term", "bad", "good"])


def longest(rows: list) -> tuple[tuple[str, float], ...]:
    """(term, weight) of rows (term, bad, good, weight), without beginnings that stand in no other texts than a longer one."""
    known = {(r["term"], r["bad"], r["good"]) for r in rows if not r["term"].endswith(" ")}
    more = {(t[:k], bad, good) for t, bad, good in known for k in range(2, len(t))}
    return tuple((r["term"], r["weight"]) for r in rows if (r["term"], r["bad"], r["good"]) not in more)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon, the phrases of exception and the curve from labelled rows that are not held out."""
    with Tables() as tables:
        marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic")).where(~held_out())
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
        rows = texts.select("doc_id", "h").join(marks, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
        rows = tables.saved(smallest(tables.saved(rows), F.xxhash64("h", F.lit(2)), sample))
        labelled = tables.saved(texts.join(F.broadcast(rows), ["doc_id", "h"]).dropDuplicates(["h"]).select("text", "toxic"))
        totals = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
        if not n_bad or not n_good:
            return Model((), None)
        odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        summed = lambda count: labelled.mapInArrow(K.tidy(count), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        best = summed(_count_terms).where(F.col("bad") >= SUPPORT).select("term", "bad", "good", (odds - Z * error).alias("weight")).where(F.col("weight") >= LEAST)
        terms = longest(best.orderBy(F.desc("weight"), "term").collect())  # bounded by the sample
        harmless = summed(_count_phrases(frozenset(t for t, _ in terms))).where(F.col("good") >= SUPPORT).where(odds + Z * error < 0)
        phrases = tuple(sorted({*EXCEPTIONS, *(r["term"] for r in harmless.select("term").collect())}))
        model = Model(terms, None, phrases)
        got = labelled.mapInArrow(K.tidy(_weights(model)), "weight double, words long, toxic long").toPandas()  # `sample` rows at most
    got = got.sort_values(["weight", "words", "toxic"])
    return Model(terms, fit_curve(got.weight.to_numpy(), got.words.to_numpy(float), got.toxic.to_numpy(float)), phrases)


def _weights(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            got = [weigh(t, _automaton(model)) for t in fold([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64()), batch.column(1)], ["weight", "words", "toxic"])

    return run


def _scores(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            got = [weigh(t, _automaton(model)) for t in fold([t or "" for t in texts.to_pylist()])]
            weight, words = np.array([w for w, _ in got], float), np.array([n for _, n in got], float)
            if model.curve is None:
                score = np.zeros(len(got))
            else:
                score = 1 / (1 + np.exp(-np.clip(features(weight, words) @ np.array(model.curve), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return run


def held_out():
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text as another column; an own column of that name is replaced."""
    rows = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(K.tidy(_scores(model, name)), f"{fields}, `{name}` double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text isn't toxic, all columns as they are."""
    own = "__toxicity"
    while own in docs.columns:
        own += "_"
    return score(docs, model, own).where(F.col(own) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
