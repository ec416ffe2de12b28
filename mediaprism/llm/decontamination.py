"""Benchmark decontamination by winnowing, with built-in functions only.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Of every ``window`` - K + 1
consecutive K-word hashes the smallest is kept as a fingerprint, so a span of ``window`` words that a
document shares with an item always has a fingerprint in common at the same place. Documents and
items meet on fingerprints; each meeting is extended word by word both ways, as far as a window
around it can reach. A run of at least ``window`` words counts as a hit. An item shorter than that has
to occur whole; its own length gives its fingerprint.

A benchmark whose fingerprints are known to be few, in rows and in bytes, is broadcast, and texts never leave
their task. Beyond ``broadcast_rows`` or ``broadcast_bytes`` both sides are shuffled by fingerprint, only documents that
met an item are brought together with their words again, and all others keep their place by a join on their hits.

Cases: a null text or item, or one without words, has none and hits nothing; repeated documents
give repeated rows, repeated items count once by id; an empty benchmark leaves every document
clean; an item without an id hits as any other, but is not among the items named; texts may have up to 2^30 words; columns other than those named are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaprism.llm.common import saved, text_key

#: Words a fingerprint spans.
K = 5
_POSITION_BITS = 30
#: A fingerprint no hash can have, as hashes are cut to 34 bits: one per document, met by one row.
_EVERY = 1 << 40

# What separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # Lower-casing all of a text is the same where it is ASCII only, and far cheaper.
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, as plans may otherwise repeat it inside a loop over it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _grams(words: Column, k: int) -> Column:
    """Hash and place of each k-word gram in one number, the hash above the place."""
    n = F.size(words) - k
    return F.transform(
        F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.slice(words, i + 1, F.lit(k))), _POSITION_BITS), _POSITION_BITS) + i,
    )


def _winnowed(words: Column, window: int) -> Column:
    """The smallest of each window's K-grams; none where the text is shorter than a window."""
    w = window - K + 1

    def smallest(grams: Column) -> Column:
        n = F.size(grams) - w
        return F.array_distinct(F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_min(F.slice(grams, i + 1, F.lit(w)))))

    return _once(_grams(words, K), smallest)


def _hash(gram: Column) -> Column:
    return F.shiftright(gram, _POSITION_BITS)


def _place(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")


def _as_fingerprint(k: int):
    return lambda g: F.struct(F.lit(k).alias("k"), _hash(g).alias("fp"), _place(g).alias("p"))


def item_fingerprints(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """fp, k (words it spans), whole (the item's words if they are fewer than a window, else null), context (words around), at (its place there), items that have all this.

    A phrase that many items hold in the same words is one mark, so a document meets and extends it once.
    """
    rows = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    long = rows.where(F.size("words") >= window).select("item", "words", F.explode_outer(_winnowed(F.col("words"), window)).alias("gram"))
    place = _place(F.col("gram"))
    before = F.least(place, F.lit(window - K))
    long = long.select(_hash(F.col("gram")).alias("fp"), F.lit(K).alias("k"), "item", F.lit(None).cast("int").alias("whole"), F.slice("words", place - before + 1, before + window).alias("context"), before.alias("at"))
    short = rows.where(F.size("words") < window)
    short = short.select(_hash(F.xxhash64("words")).alias("fp"), F.size("words").alias("k"), "item", F.size("words").alias("whole"), F.col("words").alias("context"), F.lit(0).alias("at"))
    return long.unionByName(short).groupBy("fp", "k", "whole", "context", "at").agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, items: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 200_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: id, n_words, spans (start, length of the runs found), items (those that occur)."""
    marks = saved(item_fingerprints(items, window, item_col, item_text_col))
    heavy = F.aggregate("context", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 40) + 40 * F.size("items")
    sizes = marks.groupBy("whole").agg(F.count("*").alias("n"), F.sum(heavy + 100).alias("bytes")).collect()  # window rows at most
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("version"), words_of(text).alias("words"))
    found = [F.transform(_winnowed(F.col("words"), window), _as_fingerprint(K))]
    found += [F.transform(_grams(F.col("words"), k), _as_fingerprint(k)) for k in sorted(r["whole"] for r in sizes if r["whole"])]

    if sum(r["n"] for r in sizes) <= broadcast_rows and sum(r["bytes"] for r in sizes) <= broadcast_bytes:
        # A row meets the marks where it is. One more fingerprint, met by one more mark, stands for each document, and
        # an outer explode spares Spark a filter that computes them twice.
        every = marks.sparkSession.range(1).select(F.lit(_EVERY).alias("fp"), F.lit(0).alias("k"), F.lit(None).cast("int").alias("whole"), F.array().cast("array<string>").alias("context"), F.lit(0).alias("at"), F.array().cast(marks.schema["items"].dataType).alias("items"))
        found = F.concat(F.array(F.struct(F.lit(0).alias("k"), F.lit(_EVERY).alias("fp"), F.lit(0).alias("p"))), *found)
        met = rows.select("id", "version", "words", F.explode_outer(found).alias("f")).select("id", "version", "words", "f.k", "f.fp", "f.p").join(F.broadcast(marks.unionByName(every)), ["k", "fp"])
        per = _spans_of(met, window).groupBy("id", "version", "n_words").agg(F.sum("rows").cast("int").alias("rows"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.collect_set("span").alias("spans"))
        out = per.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
    else:
        # Only fingerprints travel. Documents that meet an item get their words again, and all others none.
        prints = rows.select("id", "version", F.explode(F.concat(*found)).alias("f")).select("id", "version", "f.k", "f.fp", "f.p")
        met = saved(prints.join(marks, ["k", "fp"]))
        which = met.select("id", "version").distinct().withColumnsRenamed({"id": "_id", "version": "_version"})
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
        texts = docs.select(F.col(id_col).alias("id"), text_key(text).alias("version"), text.alias("text")).join(which, same, "left_semi").dropDuplicates(["id", "version"])
        texts = texts.select(F.col("id").alias("_id"), F.col("version").alias("_version"), words_of(F.col("text")).alias("words"))
        hits = _spans_of(met.join(texts, same).drop("_id", "_version"), window).where("span IS NOT NULL")
        per = hits.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.collect_set("span").alias("spans"))
        counted = docs.select(F.col(id_col).alias("id"), text_key(text).alias("version"), F.size(words_of(text)).alias("n_words"))
        out = counted.join(per, same, "left").withColumns({"items": F.coalesce("items", F.array().cast(marks.schema["items"].dataType)), "spans": F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))})
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.sort_array("spans").alias("spans"), "items")


def _spans_of(met: DataFrame, window: int) -> DataFrame:
    """Of meetings (words, p, context, at, items, whole) the run that each extends to, where it is long enough: id, version, n_words, items, span; rows says which stands for a document."""
    # Equality along the meeting's diagonal, in the context's places.
    p, at, n = F.col("p"), F.col("at"), F.size("words")
    lo = F.greatest(F.lit(0), at - p)
    hi = F.least(F.size("context"), n - p + at)
    met = met.select("id", "version", n.alias("n_words"), (F.col("k") == 0).alias("marker"), "items", "whole", p.alias("p"), (at - lo).alias("before"), F.zip_with(F.slice("words", p - at + lo + 1, F.greatest(hi - lo, F.lit(0))), F.slice("context", lo + 1, F.greatest(hi - lo, F.lit(0))), lambda a, b: a == b).alias("same"))
    right = F.array_position(F.slice("same", F.col("before") + 1, F.size("same")), False)
    left = F.array_position(F.reverse(F.slice("same", F.lit(1), F.col("before"))), False)
    met = met.select(
        "id",
        "version",
        "n_words",
        "marker",
        "items",
        "whole",
        F.when(right > 0, right - 1).otherwise(F.size("same") - F.col("before")).cast("int").alias("after"),
        F.when(left > 0, left - 1).otherwise(F.col("before")).cast("int").alias("ahead"),
        "p",
    )
    length = F.col("after") + F.col("ahead")
    hit = ~F.col("marker") & (length >= F.coalesce("whole", F.lit(window)))
    return met.select("id", "version", "n_words", F.when(hit, F.col("items")).alias("items"), F.when(hit, F.struct((F.col("p") - F.col("ahead")).alias("start"), length.alias("length"))).alias("span"), F.when(F.col("marker"), 1).otherwise(0).alias("rows"))


def covered(spans: Column) -> Column:
    """How many places sorted spans cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )


def decontamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated (at least a twentieth of the words hit)."""
    hits = find_hits(docs, items, **options)
    first = hits.columns[0]
    rows = hits.select(first, "n_words", covered(F.col("spans")).alias("n_hit"), F.sort_array(F.transform("items", lambda i: i.cast("string"))).alias("items"))
    return rows.select(
        first,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
