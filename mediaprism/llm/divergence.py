"""Source divergence audit: how far each source's use of words lies from that of the other sources of its language.

A language keeps the terms that at least ``least_docs`` of its documents hold. Each of its sources, and the language
itself, gives every kept term the smoothed share ``p = 1 + floor(unit * (count + 5) / (N + 5 V))``. Two sources differ by the
sum of ``|p - q|`` over all kept terms; a term stands out in a source by ``p - q`` against the language.

Terms of one language with the same sparse vector of counts by source form one class. Each pair of sources is evaluated once
per class and multiplied by the class's number of terms. Where both counts of a pair are zero a class adds what every absent
term adds, so the sum over all terms is taken from that in closed form, and a class only corrects the rows of the sources that
it occurs in. Of each class the first terms by name are ranked, as all have one value. Everything is whole numbers: products beyond 64 bits
are decimals.

Counting takes one pass, sums in each task before anything is shuffled, and sends one row per (language, source, term) and
flush; so neither a hot source nor a frequent word makes a large group. Classes are dealt by themselves, not by language. A task holds the
sums of one language and ``block`` of its sources against all of its sources.

Cases: null text, lang or source are empty; repeated rows count as often as they stand there; documents without terms still make their
source a group; a language without kept terms gives pairs of value 0; ties go to the smaller name by UTF-8 bytes; an empty
table gives no rows; columns not named are not read. Long texts are counted in chunks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.llm.common import saved
from mediaprism.llm.terms import LETTERS, terms


def _counts(held: int):
    """Occurrences and documents by (lang, source, term). A row with an empty term says that the group exists."""

    def run(batches):
        yield from _count(batches, held)

    return run


def _count(batches, held: int):
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in groups.items():
            names = [b"", *n]
            size = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(names, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for b in batches:
        lang, source, text = b.columns
        for where, t in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), text.cast(pa.binary()), strict=True):
            n, docs = groups.setdefault(where, (Counter(), Counter()))
            seen = set()
            for some in terms(t.as_py(), LETTERS):
                n.update(some)
                seen.update(some)
            docs.update(seen)
        if sum(len(n) for n, _ in groups.values()) + len(groups) > held:
            yield from flush()
    yield from flush()


def count_terms(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", held: int = 300_000) -> DataFrame:
    """lang, source, term, n, docs: one row each; every group has one with the empty term too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    parts = rows.mapInArrow(_counts(held), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column, unit: int) -> Column:
    above = (count + 5).cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)")
    return F.call_function("div", above, (total + 5 * kept).cast("decimal(20,0)")) + 1


def _correct(batches, size: int):
    """By source i, what classes add to the sums over all j beyond the closed form, doubled.

    A class counts whole in the rows of its own sources: twice against sources it does not occur in, once against its own,
    which count it as well. Rows (lang, block, sources, base, places, shares, times) come in the order of lang and block.
    """
    held = None

    def flush():
        lang, first, sums = held
        used = np.flatnonzero(sums.any(axis=1))
        lengths = np.arange(len(used) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array((used + first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(lengths), pa.array(sums[used].ravel()))], ["lang", "i", "sums"]
        )

    for b in batches:
        lists = {k: (b.column(k).flatten().to_numpy(), np.concatenate([[0], np.cumsum(b.column(k).value_lengths().to_numpy())])) for k in ("base", "places", "shares")}
        for r, (lang, block, times) in enumerate(zip(b.column("lang").to_pylist(), b.column("block").to_pylist(), b.column("times").to_pylist(), strict=True)):
            base, places, shares = (values[at[r] : at[r + 1]] for values, at in lists.values())
            first = block * size
            if held is None or held[0] != lang or held[1] != first:
                if held:
                    yield from flush()
                held = lang, first, np.zeros((min(size, len(base) - first), len(base)), np.int64)
            p = base.copy()
            p[places] = shares
            own = places[(places >= first) & (places < first + size)]
            weight = np.full(len(base), 2 * times)
            weight[places] = times
            held[2][own - first] += weight * (np.abs(p[own, None] - p) - np.abs(base[own, None] - base))
    if held:
        yield from flush()


def _corrections(size: int):
    def run(batches):
        yield from _correct(batches, size)

    return run


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, unit: int = 1_000_000_000, most_terms: int = 50, held: int = 300_000, block: int = 256) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` has all other sources of the language by distance, part
    ``term`` the ``most_terms`` terms by which the source stands out most. A counting task sends on what it has beyond ``held`` entries."""
    counts = saved(count_terms(docs, lang_col=lang_col, source_col=source_col, text_col=text_col, held=held))
    # Sources by number within their language, in the order of names.
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = saved(counts.where("term = ''").select("lang", "source", (F.row_number().over(by_name) - 1).alias("i")))
    vector = F.sort_array(F.collect_list(F.struct("i", "n")))
    kept = saved(
        counts.where("term <> ''").join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector.alias("vector")).where(F.col("docs") >= least_docs).drop("docs")
    )
    sums = kept.select("lang", F.explode("vector").alias("v")).groupBy("lang", F.col("v.i").alias("i")).agg(F.sum("v.n").alias("total"))
    sources = groups.join(sums, ["lang", "i"], "left").select("lang", "i", "source", F.coalesce("total", F.lit(0)).alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    members = sources.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "source", "total"))).alias("m")).join(langs, "lang", "left")
    members = saved(members.select("lang", "m", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("all", F.lit(0)).alias("all")))
    share = lambda n, total: _share(n, total, F.col("kept"), unit)
    base = F.when(F.col("kept") > 0, F.transform("m", lambda x: share(F.lit(0).cast("long"), x["total"]))).otherwise(F.transform("m", lambda x: F.lit(0).cast("long")))
    members = members.withColumn("base", base)

    # Classes of terms, and in each the first terms by name.
    classes = kept.groupBy("lang", "vector").agg(F.count("*").alias("times")).join(members, "lang")
    shares = F.transform("vector", lambda v: share(v["n"], F.get(F.col("m"), v["i"])["total"]))
    places = F.transform("vector", lambda v: v["i"])
    classes = classes.select("lang", "base", places.alias("places"), shares.alias("shares"), "times", F.explode(F.array_distinct(F.transform("vector", lambda v: F.floor(v["i"] / block).cast("int")))).alias("block"))
    corrections = classes.sortWithinPartitions("lang", "block").mapInArrow(_corrections(block), "lang string, i int, sums array<long>")
    sides = corrections.select("lang", "i", F.posexplode("sums").alias("j", "a")).where("i <> j and a <> 0").groupBy("lang", "i", "j").agg(F.sum("a").alias("a"))
    sides = sides.select("lang", F.explode(F.array(F.struct("i", "j", "a"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "a"))).alias("s")).groupBy("lang", "s.i", "s.j").agg(F.sum("s.a").alias("a"))
    one = members.select("lang", "m", "kept", "base", F.posexplode("m").alias("i", "own"))
    pairs = one.select("lang", "kept", "base", F.col("own.source").alias("source"), "i", F.posexplode("m").alias("j", "other")).where("i <> j")
    apart = F.abs(F.get(F.col("base"), F.col("i")) - F.get(F.col("base"), F.col("j"))) * F.col("kept")
    pairs = pairs.select("lang", "source", "i", "j", F.col("other.source").alias("item"), apart.alias("apart")).join(sides, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("apart") + F.coalesce(F.call_function("div", F.col("a"), F.lit(2)), F.lit(0))).alias("value"))

    in_class = Window.partitionBy("lang", "vector").orderBy("term")
    firsts = kept.withColumn("nth", F.row_number().over(in_class)).where(F.col("nth") <= most_terms).join(members.select("lang", "m", "kept", "all"), "lang")
    beyond = F.transform("vector", lambda v: F.struct(F.get(F.col("m"), v["i"])["source"].alias("source"), (share(v["n"], F.get(F.col("m"), v["i"])["total"]) - share(F.col("total"), F.col("all"))).alias("f")))
    found = firsts.select("lang", F.col("term").alias("item"), F.explode(F.filter(beyond, lambda x: x["f"] > 0)).alias("x"))
    stand_out = found.select("lang", "x.source", F.lit("term").alias("part"), "item", F.col("x.f").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(stand_out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms))
