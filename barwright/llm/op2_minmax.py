"""Near-duplicate detection with min-max hashing.

Every permutation of a shingle set gives two signature values, its minimum and its maximum, so a signature of v values
costs v / 2 hash passes. Bands of six values make candidate buckets; the number of bands follows from the similarity
so that a pair at the threshold is missed with probability below MISS. Sets are compared exactly afterwards.

Scale: identical sets fold into one class before banding; buckets yield one edge a member (to their smallest), never
pairs; the candidate groups these edges form are compared in blocks, bounded in members and in bytes, inside tasks, with hubs
shared by all blocks of a group and a second pass for what the hubs did not reach. No link between different sets is skipped:
the second pass compares every member outside its group's main component with every block. Six values a band keep such groups
small: a pair that shares a third of its shingles meets in one of 30 bands with a probability of 4 %.

Shingles are 64-bit hashes of words that are hashed in steps of eight bytes with xorshift between them (xxh3 for very long
ones), so no family of texts collides by construction; by chance two of n different shingles do with a probability of n^2 / 2^65.

Defined results: null or empty text has an empty set and is linked with nothing; rows without a doc_id are returned
unlinked; repeated rows are copies; rows of one doc_id with different texts are compared each, as documents that share an id;
an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import kernels as K
from barwright.llm.components import connected_components
from barwright.llm.store import Tables

ROWS = 6  # signature values in a band: three permutations, each with minimum and maximum
MISS = 1e-6
BLOCK = 1024  # members of a candidate group compared in one task
BLOCK_SHINGLES = 4 << 20  # and their shingles, about
HUBS = 32  # members of a split group that all its blocks see, about


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = K.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, offsets: np.ndarray, bands: int) -> np.ndarray:
    """Band keys (rows x bands, int64) of the sets that aren't empty, by min-max hashing."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    passes = ROWS // 2
    mul, add = _multipliers(passes * bands)
    keys = np.zeros((len(starts), bands), np.uint64)
    for j in range(bands):
        acc = np.full(len(starts), j + 1, np.uint64)
        for p in range(passes * j, passes * j + passes):
            mixed = low * mul[p] + add[p]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            for extreme in (np.minimum, np.maximum):
                acc = acc * np.uint64(0x9FB21C651E98DF25) + extreme.reduceat(mixed, starts) + np.uint64(1)
        keys[:, j] = K.mix(acc)
    return keys.view(np.int64)


def _sketch(k: int, bands: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            values, offsets = K.shingle_sets(batch.column(2), k)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            f = np.zeros((2, len(size)), np.uint64)
            at = np.zeros(len(size) + 1, np.int32)
            keys = np.zeros((0, bands), np.int64)
            if len(full):
                f[0, full] = np.add.reduceat(K.mix(values), offsets[:-1][full])
                f[1, full] = np.add.reduceat(K.mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), offsets[:-1][full])
                keys = signatures(values, offsets, bands)
            at[1:] = np.cumsum((size > 0) * bands)
            f = f.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(f[0]), pa.array(f[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))], schema=schema)

    return run


def _as_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            values, offsets = K.shingle_sets(batch.column(batch.schema.get_field_index("text")), k)
            raw, at = values.tobytes(), (offsets * 8).tolist()
            sets = pa.array([raw[at[i] : at[i + 1]] for i in range(batch.num_rows)], pa.binary())
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), sets], [*names, "shingles"])

    return run


def _links(percent: int):
    """Links inside one block: rows with `left` are compared with all rows; every pair of two components is compared."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["rep", "shingles"]).reset_index(drop=True)
        sets = [np.frombuffer(b, np.uint64) for b in frame.shingles]
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, ids = np.unique(flat, return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        reps, known, left = frame.rep.to_numpy(), frame.known.to_numpy().copy(), frame.left.to_numpy()
        mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        later = np.ones(len(reps), bool)  # not yet compared with all others
        a, b = [], []
        # components found so far; members of the component at hand needn't be compared with each other again
        for i in np.flatnonzero(left):
            later[i] = False
            others = np.flatnonzero(later & (known != known[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
            if not len(others):
                continue
            mark[ids[at[i] : at[i + 1]]] = 1
            hits = np.add.reduceat(mark[ids[K.ranges(at[others], size[others])]], np.concatenate([[0], np.cumsum(size[others])[:-1]]))
            mark[ids[at[i] : at[i + 1]]] = 0
            for j in others[100 * hits >= percent * (size[others] + size[i] - hits)]:
                if known[j] != known[i]:
                    a.append(reps[i])
                    b.append(reps[j])
                    known[known == known[j]] = known[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (Spark's xxhash64 of the text) for each row: links at
    100 * |A & B| >= percent * |A | B|."""
    with Tables() as tables:
        return _classified(docs, words, percent, block, tables)


def _classified(docs: DataFrame, words: int, percent: int, block: int, tables: Tables) -> DataFrame:
    bands, saved = bands_for(percent), tables.saved
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = saved(base.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(K.tidy(_sketch(words, bands)), "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, bands array<long>"))
    usable = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = saved(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    firsts = saved(rows.groupBy("bucket").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "first"))
    edges = rows.join(firsts, "bucket").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(edges, tables).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    sized = groups.join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n")), "rep")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES))
    sizes = saved(sized.groupBy("grp").agg(parts.alias("blocks"), F.count(F.lit(1)).alias("members")))
    members = groups.join(sizes, "grp").select("rep", "grp", "blocks", "members")
    texts = base.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text")
    sets = members.join(texts, "rep").mapInArrow(K.tidy(_as_sets(words)), "rep long, grp long, blocks long, members long, shingles binary")
    sets = saved(sets)
    own_block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("members") / HUBS))) == 0)
    spread = sets.select("rep", "grp", F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own_block))).alias("block"), "shingles")
    spread = spread.select("rep", "grp", "block", F.col("rep").alias("known"), F.lit(True).alias("left"), "shingles")
    links = saved(spread.groupBy("grp", "block").applyInPandas(_links(percent), "a long, b long"))
    split = sizes.where("blocks > 1")
    if not split.isEmpty():
        found = connected_components(links, tables).select(F.col("node").alias("rep"), "component")
        known = saved(sets.join(split.select("grp"), "grp", "left_semi").select("rep", "grp", "blocks").join(found, "rep", "left").select("rep", "grp", "blocks", F.coalesce("component", "rep").alias("known")))
        main = known.groupBy("grp", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("known", F.struct("n", F.col("known"))).alias("main"))
        known = saved(known.join(main, "grp"))
        rest = saved(known.where("known <> main").groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).alias("lots")))
        whole = sets.select("rep", "shingles").join(known.dropDuplicates(["rep"]), "rep").join(rest, "grp")
        lot = F.pmod(F.xxhash64("rep", F.lit(11)), F.col("lots"))
        to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        right = whole.select("grp", "rep", "known", "shingles", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.explode(to("lots")).alias("lot"), F.lit(False).alias("left"))
        left = whole.where("known <> main").select("grp", "rep", "known", "shingles", F.explode(to("blocks")).alias("block"), lot.alias("lot"), F.lit(True).alias("left"))
        again = left.unionByName(right).groupBy("grp", "block", "lot").applyInPandas(_second(percent), "a long, b long")
        links = links.unionByName(saved(again))
    components = connected_components(links, tables).select(F.col("node").alias("rep"), "component")
    labelled = classes.select("f1", "f2", "n_shingles", "rep").join(components, "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    labelled, marks = saved(labelled), saved(sketch.drop("bands"))
    tables.keep(labelled, marks)  # the result reads these two
    full = marks.where("doc_id IS NOT NULL AND n_shingles > 0").join(labelled, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"), "text_hash")
    alone = marks.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return full.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def _second(percent: int):
    links = _links(percent)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return links(frame.sort_values("left", ascending=False))  # a member that stands on both sides counts as left

    return run
