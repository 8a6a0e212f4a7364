"""Information-theoretic sanitisation, with DataFrame functions only.

Protected entities are what the base patterns find (email, ip, card, phone), and secrets: strings of letters and digits whose
own information, length times the bits of their alphabet, reaches SECRET_BITS. The method then estimates from the corpus how
strongly other terms reveal an entity, each value by itself and each kind as a whole: with n_t, n_c and n_ct the documents that
hold the term, the entity and both, of N, the term's pointwise mutual information log2(N n_ct / (n_c n_t)) is set against
the entity's information log2(N / n_c). A term whose share reaches DISCLOSURE, in at least SUPPORT distinct texts with the
entity, discloses it and is a span of kind `term` in every document with that entity. Near copies of a text count once
as support: texts are folded by the similarity of the whole texts, so a fixed phrase in otherwise different texts (a signature,
a key's name) is evidence and one text with small changes isn't.

Sizes: words are counted with map-side partial sums. A term can only disclose an entity if nearly all its documents hold
some supported entity, which one count decides before any (term, entity) pair is made; that is a necessary condition, so
no term is lost. Spans come from match lengths (code points, end exclusive).

Defined results: null text is empty and has no spans; rows with one text get the same spans; null doc_id stays; an empty
table gives an empty result; extra columns are ignored by find_spans() and kept by sanitise(), whatever their names. Patterns
have possessive groups, so very long runs don't recurse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.store import Tables

# The patterns of the base kinds, in the order in which spans are listed.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+"
SECRET_BITS = 96  # information that makes a string of letters and digits a secret
SECRET_TURNS = 3  # times that a digit is followed by a letter in it, which words with a number rarely have
FOUND = (*KINDS, "secret")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
DISCLOSURE = 0.95  # share of an entity's information that a term may reveal
SUPPORT = 5  # texts, near copies folded, in which a term must stand with an entity
SHINGLE, BUCKETS, BAND = 3, 60, 3  # words a shingle, values of a text's sketch, values that are looked up together
SIMILAR = 0.5  # texts fold when this share of their shingles agrees, as their sketches estimate it
TERM_CHARS = 3  # shorter terms are never spans of their own


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    weigh = lambda acc, i: acc + F.when((n - i) % 2 == 1, twice(value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weigh) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_IP_PARTS)
    if kind == "secret":
        hexadecimal, one_case = match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), match.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$")
        bits = F.length(match) * F.when(hexadecimal, 4.0).when(one_case, 5.17).otherwise(5.95)  # log2 of 16, 36 and 62
        return (bits >= SECRET_BITS) & (F.regexp_count(match, F.lit("[0-9][A-Za-z]")) >= SECRET_TURNS)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15)


def _checked(kind: str):
    return lambda s: _valid(kind, s.getField("value"))


def _might(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "secret":
        return text.rlike(SECRET)
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")


def _placed(text: Column, pattern: str | Column, matches: Column) -> Column:
    """(start, end, value) of matches, from the lengths of what stands between them."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(matches, F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, x: F.struct(
        (acc.getField("at") + x.getField("gap") + x.getField("size")).alias("at"),
        F.concat(acc.getField("starts"), F.array(acc.getField("at") + x.getField("gap"))).alias("starts"),
    )
    both = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), sizes, lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    # a hundred matches at a time: appending to an array is quadratic in its length
    chunk = 100
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / chunk).cast("int")), lambda i: F.slice(both, i * chunk + 1, F.lit(chunk)))
    local = F.transform(lots, lambda lot: F.aggregate(lot, zero, step))
    heads = F.aggregate(local, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda acc, x: F.struct((acc.getField("at") + x.getField("at")).alias("at"), F.concat(acc.getField("starts"), F.array(acc.getField("at"))).alias("starts"))).getField("starts")
    starts = F.flatten(F.zip_with(local, heads, lambda x, h: F.transform(x.getField("starts"), lambda s: s + h)))
    return F.zip_with(starts, matches, lambda s, m: F.struct(s.cast("long").alias("start"), (s + F.length(m)).cast("long").alias("end"), m.alias("value")))


Save = Callable[[DataFrame], DataFrame]
_ALL = PATTERNS | {"secret": SECRET}
_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds text (null: empty) and one array of (start, end, value) for each base kind and for secrets."""
    out = docs
    for kind, pattern in _ALL.items():
        text = F.col("text")
        out = out.withColumn(f"m_{kind}", F.when(_might(kind, text), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    for kind, pattern in _ALL.items():
        found = F.when(F.size(f"m_{kind}") > 0, F.filter(_placed(F.col("text"), pattern, F.col(f"m_{kind}")), _checked(kind)))
        out = out.withColumn(kind, F.coalesce(found, F.array().cast(_SPANS))).drop(f"m_{kind}")
    return out


def _entities() -> Column:
    """Distinct protected values of a document (digits of numbers, lower-cased addresses), and the kinds that it holds."""
    norm = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits, "secret": lambda v: v}
    each = lambda k: F.transform(k, lambda s: F.concat(F.lit(k + ":"), norm[k](s.getField("value"))))
    kind = lambda k: F.when(F.size(k) > 0, F.array(F.lit(k))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(each, FOUND), *map(kind, FOUND)))


def _blanked(text: Column) -> Column:
    """The text without base matches."""
    rest = text
    for kind, pattern in _ALL.items():
        rest = F.when(_might(kind, text), F.regexp_replace(rest, pattern, " ")).otherwise(rest)
    return rest


def _is_term(word: Column) -> Column:
    return F.length(word) >= TERM_CHARS


def _survey(docs: DataFrame) -> DataFrame:
    """Base spans, entities and text hashes of each row; the text stays only where there is an entity."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    out = out.withColumn("entities", _entities())
    some = F.size("entities") > 0
    return out.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), *FOUND, F.when(some, F.col("entities")).alias("entities"), F.when(some, F.col("text")).alias("text"))


def _folds(texts: DataFrame, saved: Save) -> DataFrame:
    """(h1, fold) for texts (h1, words): near copies get the hash of one text of theirs, others their own.

    The sketch of a text is the smallest shingle hash of each bucket. Texts that agree in a band are linked to the
    smallest one with it if their sketches agree, and links are followed to their end: work is linear in the texts.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - SHINGLE + 1, F.lit(1)))
    hashes = texts.select("h1", F.explode(F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(SHINGLE))))).alias("x"))
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS))
    lows = saved(hashes.groupBy("h1", bucket(F.col("x")).alias("bucket")).agg(F.min("x").alias("x")))
    bands = lows.groupBy("h1", F.floor(F.col("bucket") / BAND).alias("band")).agg(F.xxhash64(F.sort_array(F.collect_list("x"))).alias("key"))
    heads = bands.groupBy("band", "key").agg(F.min("h1").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    edges = bands.join(heads, ["band", "key"]).where("head < h1").select("h1", "head").distinct()
    sketches = lows.groupBy("h1").agg(F.collect_list("x").alias("own"))
    both = edges.join(sketches, "h1").join(sketches.select(F.col("h1").alias("head"), F.col("own").alias("its")), "head")
    either = F.size(F.array_union(F.transform("own", bucket), F.transform("its", bucket)))
    links = saved(both.where(F.size(F.array_intersect("own", "its")) >= SIMILAR * either).groupBy("h1").agg(F.min("head").alias("fold")))
    while True:  # each round doubles the links that are followed
        further = links.select(F.col("h1").alias("fold"), F.col("fold").alias("end"))
        if links.join(further, "fold", "leftsemi").isEmpty():
            break
        links = saved(links.join(further, "fold", "left").select("h1", F.coalesce("end", "fold").alias("fold")))
    return texts.select("h1").distinct().join(links, "h1", "left").select("h1", F.coalesce("fold", "h1").alias("fold"))


def disclosing_terms(docs: DataFrame, survey: DataFrame, saved: Save, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, term) for the terms that disclose an entity of their text, and (entity, term, share) with the estimates.

    Evidence is at least `support` texts, near copies folded: in near copies every rare word stands with the entity.
    """
    holding = survey.where("entities IS NOT NULL").select("h1", "h2", F.explode("entities").alias("entity"))
    entities = saved(holding.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.countDistinct("h1", "h2").alias("texts")).where(F.col("texts") >= support))
    held = saved(holding.join(entities, "entity").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("pairs"), F.collect_set("entity").alias("held"), F.max(F.lit(1)).alias("one")))
    # rows of a text: pairs / entities in it
    held = held.select("h1", "h2", "held", (F.col("pairs") / F.size("held")).cast("long").alias("copies"))
    texts = survey.where("text IS NOT NULL").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    words = F.filter(F.split(F.lower(_blanked(F.col("text"))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    near = saved(texts.join(held, ["h1", "h2"]).select("h1", "h2", "held", "copies", words.alias("words")))
    own = F.explode(F.array_distinct(F.filter("words", _is_term))).alias("term")
    near = saved(near.join(_folds(near, saved), "h1").select("h1", "h2", "held", "copies", "fold", own))
    candidates = near.groupBy("term").agg(F.sum("copies").alias("n_any"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    terms = F.filter(F.array_distinct(F.split(F.lower(_blanked(text)), r"[^\p{L}\p{N}]+")), _is_term)
    everywhere = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = survey.agg(F.count(F.lit(1)).alias("n"))
    rarest = entities.agg(F.min("n_c").alias("least"))
    # n_ct <= n_any and n_c >= least, so a term below this bound discloses nothing
    known = everywhere.join(candidates, "term").join(F.broadcast(total.join(rarest)))
    bound = F.col("n_any") / F.col("n_t") >= F.pow(F.col("least") / F.col("n"), F.lit(1 - disclosure))
    known = saved(known.where(bound).select("term", "n_t", "n"))
    pairs = near.join(known, "term").select("h1", "h2", "term", "n_t", "n", "copies", "fold", F.explode("held").alias("entity"))
    joint = pairs.groupBy("entity", "term", "n_t", "n").agg(F.sum("copies").alias("n_ct"), F.countDistinct("fold").alias("texts"))
    joint = joint.where(F.col("texts") >= support).join(entities.select("entity", "n_c"), "entity")
    pmi = F.log2(F.col("n").cast("double") * F.col("n_ct") / (F.col("n_c").cast("double") * F.col("n_t")))
    information = F.log2(F.col("n").cast("double") / F.col("n_c"))
    estimates = saved(joint.where(F.col("n") > F.col("n_c")).withColumn("share", pmi / information).where(F.col("share") >= disclosure).select("entity", "term", "share"))
    found = near.select("h1", "h2", "term", F.explode("held").alias("entity")).join(estimates.select("entity", "term"), ["entity", "term"]).select("h1", "h2", "term").distinct()
    return found, estimates


def term_spans(survey: DataFrame, found: DataFrame) -> DataFrame:
    """(h1, h2, term): where the disclosing terms of a text stand, base spans left out."""
    texts = survey.where("text IS NOT NULL").groupBy("h1", "h2").agg(F.first("text").alias("text"), F.first(F.concat(*FOUND)).alias("base"))
    texts = texts.join(found.groupBy("h1", "h2").agg(F.collect_set("term").alias("terms")), ["h1", "h2"])
    # terms hold letters and numbers only, so they need no quoting
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    texts = texts.withColumn("pattern", pattern)
    spans = _placed(F.col("text"), F.col("pattern"), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    ours = F.filter(spans, lambda s: F.array_contains("terms", F.lower(s.getField("value"))) & ~F.exists("base", lambda b: (b.getField("start") < s.getField("end")) & (s.getField("start") < b.getField("end"))))
    return texts.select("h1", "h2", ours.alias("term"))


def find_spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), and an array of (start, end, value) for each base kind, for `secret` and for `term`."""
    with Tables() as tables:
        survey = tables.saved(_survey(docs))
        found, _ = disclosing_terms(docs, survey, tables.saved, disclosure, support)
        added = tables.saved(term_spans(survey, found))
        tables.keep(survey, added)
    added = added.withColumnRenamed("h1", "k1").withColumnRenamed("h2", "k2")
    out = survey.join(added, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select("doc_id", "h1", "h2", *FOUND, F.coalesce("term", F.array().cast(_SPANS)).alias("term"))


def _listed(kinds: tuple[str, ...]) -> Column:
    each = lambda k: F.transform(k, lambda s: F.concat(F.lit(k + ":"), s.getField("start").cast("string"), F.lit(":"), s.getField("end").cast("string")))
    return F.array_join(F.concat(*(each(k) for k in kinds)), ",")


def digests(spans: DataFrame) -> DataFrame:
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [F.size(k).cast("long").alias(f"n_{k}") for k in ("secret", "term")]
    return spans.select("doc_id", *counts, F.sha2(_listed(KINDS), 256).alias("base_sha256"), _listed((*FOUND, "term")).alias("spans"), *more)


def _furthest_before(spans: Column, lot: int = 100) -> Column:
    """For each span of a sorted array, the furthest end of those before it (0 for the first). By lots, as a running maximum
    over a whole array would be quadratic in its length."""
    lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / lot).cast("int")), lambda i: F.slice(spans, i * lot + 1, F.lit(lot)))
    end = lambda a: F.array_max(F.transform(a, lambda s: s.getField("end")))
    tops = F.transform(lots, end)
    before = lambda a, i: F.when(i > 0, F.slice(a, F.lit(1), i)).otherwise(F.slice(a, F.lit(1), F.lit(0)))
    zero = F.lit(0).cast("long")
    return F.flatten(F.transform(lots, lambda own, k: F.transform(own, lambda s, i: F.greatest(F.coalesce(F.array_max(before(tops, k)), zero), F.coalesce(end(before(own, i)), zero)))))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with every span of `text` put as [KIND]; overlapping spans become one, named after the first.

    Only documents with an entity can change, so only they are joined with the spans found for their texts.
    """
    with Tables() as tables:
        survey = tables.saved(_survey(docs))
        found, _ = disclosing_terms(docs, survey, tables.saved, disclosure, support)
        added = term_spans(survey, found)
        name = lambda k: F.transform(k, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), F.lit(k.upper()).alias("kind")))
        named = [name(k) for k in (*FOUND, "term")]
        per_text = survey.where("text IS NOT NULL").groupBy("h1", "h2").agg(*(F.first(k).alias(k) for k in (*FOUND, "text"))).join(added, ["h1", "h2"], "left")
        per_text = per_text.withColumn("term", F.coalesce("term", F.array().cast(_SPANS))).withColumn("all", F.array_sort(F.concat(*named))).where(F.size("all") > 0)
        # a span is kept when it starts at or after the furthest end before it
        both = F.zip_with("all", _furthest_before(F.col("all")), lambda s, b: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"), s.getField("kind").alias("kind"), b.alias("before")))
        per_text = per_text.withColumn("all", both).withColumn("heads", F.filter("all", lambda s: s.getField("start") >= s.getField("before")))
        # the text between one run of spans and the next
        last = F.array_max(F.transform("all", lambda s: s.getField("end")))
        piece = lambda h: F.concat(F.substring(F.col("text"), h.getField("before").cast("int") + 1, (h.getField("start") - h.getField("before")).cast("int")), F.lit("["), h.getField("kind"), F.lit("]"))
        body = F.concat(F.array_join(F.transform("heads", piece), ""), F.substring(F.col("text"), F.col("last").cast("int") + 1, F.length("text")))
        fixed = tables.saved(per_text.withColumn("last", last).select(F.col("h1").alias("__k1"), F.col("h2").alias("__k2"), body.alias("__sanitised")))
        tables.keep(fixed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(text, F.lit(1))})
    out = hashed.join(fixed, (F.col("__h1") == F.col("__k1")) & (F.col("__h2") == F.col("__k2")), "left")
    return out.withColumn("text", F.coalesce("__sanitised", "text")).select(*(F.col(f"`{c}`") for c in docs.columns))
