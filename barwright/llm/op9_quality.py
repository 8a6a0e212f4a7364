"""Quality rules with host-level verdicts.

Each text gets rule figures (one vectorised pass, Arrow batches); the failures of each rule are then summed by host, each
host's rates are shrunk towards the corpus with beta priors fitted to the hosts themselves, a host is judged against the
other hosts, and the verdict is joined back.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count as
often as they stand; on an empty table the result is empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K
from barwright.llm.store import saved

MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
SYMBOL_PERCENT = 10  # symbols for a hundred words
LINE_PERCENT = 30  # lines that repeat an earlier one
HOST_LIMIT = 0.5  # a host is rejected only when a rule surely fails on more than this share of its rows
HOST_Z = 3.0  # standard deviations that make it sure, of the posterior and of the other hosts' rates

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True  # fixed values: the characters counted as symbols
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIGURES = (*_NAMES, "n_lines")
# host-level rules; the first two alone decide on a document of its own
RULES = {
    "base": "base_failed",
    "words": f"n_words < {MIN_WORDS}",
    "repeats": f"n_words > 0 AND 100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {SYMBOL_PERCENT} * n_words",
    "lines": f"100 * n_dup_lines > {LINE_PERCENT} * n_lines",
}


def figures(column: pa.Array) -> dict[str, np.ndarray]:
    """The rule figures of each text of a column, as int64 arrays."""
    data, offsets = K.text_bytes(column)
    n = len(offsets) - 1
    zero = np.zeros(n, np.int64)
    if not len(data):
        return {name: zero for name in _FIGURES}
    starts, ends, rows = K.words(data, offsets)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    per_row = lambda r, w=None: np.bincount(r, w, n).astype(np.int64) if len(r) else zero
    n_symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {"n_words": per_row(rows), "word_chars": per_row(rows, leads[ends] - leads[starts]), "n_symbols": n_symbols[offsets[1:]] - n_symbols[offsets[:-1]]}
    # lines with a word that equal an earlier line
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]))
    line_rows = np.repeat(np.arange(n), 1 + np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=n)) if len(breaks) else np.arange(n)
    has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_rows, lines = line_rows[has], K.span_ids(data, line_starts[has], line_ends[has])
    order = np.lexsort((lines, line_rows))
    same = (line_rows[order][1:] == line_rows[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    out["n_lines"] = per_row(line_rows)
    out["n_dup_lines"] = per_row(line_rows[order][1:][same])
    # words in windows found twice or more
    ids = K.span_ids(data, starts, ends)
    if len(ids) >= WINDOW:
        windows = K.window_ids(ids, WINDOW)
        at = np.flatnonzero(rows[: len(windows)] == rows[WINDOW - 1 :])
        acc, r = windows[at], rows[at]
        order = np.lexsort((acc, r))
        same = (acc[order][1:] == acc[order][:-1]) & (r[order][1:] == r[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(ids), bool)
        for i in range(WINDOW):
            covered[at[twice] + i] = True
        out["n_repeat_words"] = per_row(rows[covered])
    else:
        out["n_repeat_words"] = zero
    return out


@K.tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches):
        got = figures(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[c], pa.int64()) for c in _FIGURES)], ["doc_id", "host", *_FIGURES])


def rule_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the figures of each whole text, with base_failed."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    out = out.mapInArrow(_measure, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _FIGURES))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(figs: DataFrame, limit: float = HOST_LIMIT, z: float = HOST_Z) -> DataFrame:
    """One row a host: rows, shrunken rate of base failures and verdict.

    Each rule's prior is Beta(a, b) by the method of moments over host rates (weighting hosts alike); with no spread
    between hosts it falls back to a weight of two rows. A host fails when, for some rule, its posterior mean less z
    posterior deviations is over `limit` and over what the other hosts make plausible: the mean of their rates plus z
    deviations between them. A host that stands alone has no others to be judged against.
    """
    failed = [F.sum(F.expr(rule).cast("long")).alias(f"k_{name}") for name, rule in RULES.items()]
    by_host = figs.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failed)
    rate = lambda name: F.col(f"k_{name}") / F.col("n")
    sums = [g for name in RULES for g in (F.sum(rate(name)).alias(f"s_{name}"), F.sum(rate(name) * rate(name)).alias(f"q_{name}"))]
    corpus = by_host.agg(F.count(F.lit(1)).alias("hosts"), F.sum(1.0 / F.col("n")).alias("inv"), *sums).first()  # one row of numbers
    hosts, inv = corpus["hosts"], corpus["inv"] or 0.0
    out, verdict = by_host, F.lit(False)
    for name in RULES:
        total, squares = corpus[f"s_{name}"] or 0.0, corpus[f"q_{name}"] or 0.0
        # mean and variance between hosts, sampling variance taken off
        m = total / max(hosts, 1)
        v = max(squares / max(hosts, 1) - m * m - m * (1 - m) * inv / max(hosts, 1), 0.0)
        size = m * (1 - m) / v - 1 if v > 1e-9 and m * (1 - m) > v else 2.0
        mean = m if 0 < m < 1 else 0.5
        a, b = F.col(f"k_{name}") + mean * size, F.col("n") - F.col(f"k_{name}") + (1 - mean) * size
        if name == "base":
            out = out.withColumn("host_rate", a / (a + b))
        if hosts > 1:
            others = F.greatest((total - rate(name)) / (hosts - 1), F.lit(0.0))
            between = (squares - rate(name) * rate(name)) / (hosts - 1) - others * others - others * (1 - others) * (inv - 1.0 / F.col("n")) / (hosts - 1)
            sure = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
            verdict = verdict | ((sure > limit) & (sure > others + z * F.sqrt(F.greatest(between, F.lit(0.0)))))
    return out.select("host", F.col("n").alias("host_rows"), "host_rate", verdict.alias("host_failed"))


def quality(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT, z: float = HOST_Z) -> DataFrame:
    """Rule figures of each document with its host's verdict; kept: neither the document nor its host failed.

    Spark broadcasts the verdicts only when their size allows it; else AQE splits the large hosts of the join.
    """
    figs = saved(rule_figures(docs, host))  # read twice below; the figures are small beside the texts
    verdicts = host_verdicts(figs, limit, z).withColumnRenamed("host", "h")
    out = figs.join(verdicts, F.col("host").eqNullSafe(F.col("h")), "left")
    return out.select("doc_id", *_NAMES, "base_failed", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), "host", "host_rate")
