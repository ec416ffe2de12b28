"""Ranked lexical search: the best documents of every item, by TPUT over term-partitioned postings.

One pass over the documents counts the searched terms of each whole text and its length; this forward table gives N, L and the
document frequencies. From it come the postings (term, document, contribution), dealt by ranges of term and
contribution, so that the list of a frequent word lies in many partitions, its head first. Then, for all items at once:

1. the ``head`` highest contributions of every list give partial sums, and the exact scores of each item's best heads a lower bound ``t`` of its k-th score;
2. every list is fetched down to one threshold ``T`` of its item: as list j gives no more than its head ``a_j``, ``T`` is where the sum of ``min(T, a_j)`` reaches ``t``, so a
   document that is below it everywhere scores less than ``t`` (with heads all alike this is ``t / m``; weak lists, whose heads are below it, leave the others a higher one). Partial sums
   give a better bound ``t2``, and documents go whose sum, with ``min(T, a_j)`` for each list that did not name them, stays below it;
3. the exact scores of the remaining candidates are looked up in the forward table.

All bounds keep equals, so ties are right; where fewer than k documents have a score the threshold is zero and all with a score are candidates.

No list is collected: heads are row numbers that Spark limits before it shuffles, and what is fetched is dealt by document. The items stand in the tasks that add up, in
blocks of about ``block`` (item, term) pairs by a hash of the item, so their memory is bounded however many there are. The searched terms are broadcast
to the counting tasks if they are counted to be at most ``most_terms`` and ``_ROOM`` bytes; beyond, all terms of the texts are sent and joined.

Cases: a null text has no term and is no document of N; items without a known term give no rows; each row is a document or an item of its own, also if ids are null or repeat;
equal scores go by ascending doc_id, null first, then by row; empty tables give no rows; columns not named are not read. Long texts are counted in chunks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.llm.common import saved
from mediaprism.llm.terms import ALNUM, terms

_ROOM = 64 << 20
_SCALE = 1_000_000_000
#: Cells and products that a task holds at a time.
_CELLS, _PRODUCTS = 1 << 21, 1 << 20


def _counted(known: dict[bytes, int] | None):
    """Per text its length in terms, the terms searched for (all, if none are named) and their counts."""

    def run(batches):
        for b in batches:
            sizes, at, found, counts = [], [0], [], []
            for t in b.column(b.num_columns - 1).cast(pa.binary()):
                held, n = Counter(), 0
                for some in terms(t.as_py() or b"", ALNUM):
                    n += len(some)
                    held.update(some)
                own = held.keys() if known is None else held.keys() & known.keys()
                found.extend(own if known is None else map(known.__getitem__, own))
                counts.extend(map(held.__getitem__, own))
                at.append(len(found))
                sizes.append(n)
            names = pa.array(found, pa.string() if known is None else pa.int32())
            at = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(at, names), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "tfs"])

    return run


class _Lists:
    """The lists of a block of items by term: which items a term belongs to, and what each item asks of its lists."""

    def __init__(self, pairs: np.ndarray, weights: np.ndarray, items: np.ndarray):
        by_term = pairs[np.argsort(pairs[:, 1], kind="stable")]
        self.items, self.terms = items, np.unique(by_term[:, 1])
        self.begin = np.append(np.searchsorted(by_term[:, 1], self.terms), len(by_term))
        self.owner = np.searchsorted(items, by_term[:, 0])
        self.weights = np.zeros(len(self.terms), np.int64)
        self.weights[np.searchsorted(self.terms, weights[:, 0])] = weights[:, 1]

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms are in the block, and where."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return known, at[known]

    def sums(self, lengths: np.ndarray, terms: np.ndarray, s: np.ndarray, level: np.ndarray):
        """(first row, what lists give over ``level`` by row and item, how many lists do) for some rows after others."""
        known, at = self.places(terms)
        s, row = s[known], np.repeat(np.arange(len(lengths)), lengths)[known]
        times = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=times, minlength=len(lengths)).astype(np.int64))])
        first = 0
        while first < len(lengths):
            last = int(np.searchsorted(ends, ends[first] + _PRODUCTS, "right")) - 1
            last = max(first + 1, min(last, first + max(1, _CELLS // len(self.items)), len(lengths)))
            lo, hi = np.searchsorted(row, [first, last])
            n, start = times[lo:hi], self.begin[at[lo:hi]]
            product = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if hi > lo else np.zeros(0, np.int64)
            item, value = self.owner[product], np.repeat(s[lo:hi], n)
            beyond = value - level[item]
            cell = np.repeat(row[lo:hi] - first, n) * len(self.items) + item
            cell, beyond = cell[beyond >= 0], beyond[beyond >= 0]
            shape = last - first, len(self.items)
            total = np.zeros(shape[0] * shape[1], np.int64)
            np.add.at(total, cell, beyond)
            yield first, total.reshape(shape), np.bincount(cell, minlength=len(total)).reshape(shape)
            first = last


def _lists_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.value_lengths().to_numpy(), column.flatten().to_numpy()


def _partial_sums(lists: _Lists, level: np.ndarray, k: int):
    """The k highest partial sums that the task has of each item."""

    def run(batches):
        best = np.full((k, len(lists.items)), -1, np.int64)
        for b in batches:
            lengths, terms = _lists_of(b.column("terms"))
            for _, over, named in lists.sums(lengths, terms, b.column("s").flatten().to_numpy(), level):
                both = np.concatenate([best, np.where(named > 0, over + named * level, -1)])
                best = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
        nth, item = np.nonzero(best >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(lists.items[item]), pa.array(best[nth, item])], ["item", "score"])

    return run


def _candidates(lists: _Lists, level: np.ndarray, reach: np.ndarray, least: np.ndarray):
    """Per document the items for which it may still reach ``least``."""

    def run(batches):
        for b in batches:
            lengths, terms = _lists_of(b.column("terms"))
            for first, over, named in lists.sums(lengths, terms, b.column("s").flatten().to_numpy(), level):
                row, item = np.nonzero((named > 0) & (over + reach >= least))
                own, n = np.unique(row, return_counts=True)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(own + first)), pa.ListArray.from_arrays(at, pa.array(lists.items[item]))], ["row", "items"])

    return run


def _exact(lists: _Lists, least: np.ndarray):
    """Scores, from ``least``, of the documents for the items that each names."""

    def run(batches):
        none = np.zeros(len(lists.items), np.int64)
        for b in batches:
            lengths, terms = _lists_of(b.column("terms"))
            tf, norm = b.column("tfs").flatten().to_numpy(), np.repeat(b.column("norm").to_numpy(), lengths)
            known, at = lists.places(terms)
            s = np.zeros(len(terms), np.int64)
            s[known] = lists.weights[at] * ((_SCALE * tf[known]) // (1000 * tf[known] + norm[known]))
            asked, items = _lists_of(b.column("items"))
            whose, item = np.repeat(np.arange(len(asked)), asked), np.searchsorted(lists.items, items)
            for first, score, _ in lists.sums(lengths, terms, s, none):
                here = (whose >= first) & (whose < first + len(score))
                row, of = whose[here], item[here]
                found = score[row - first, of]
                kept = (found > 0) & (found >= least[of])
                own = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays([b.column("row").take(own), b.column("doc_id").take(own), pa.array(lists.items[of[kept]]), pa.array(found[kept])], ["row", "doc_id", "item", "score"])

    return run


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _best(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbers(rows: DataFrame) -> np.ndarray:
    """Rows of two whole numbers, of a bounded number of items or terms."""
    return np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 2)


def _by_item(pairs: np.ndarray, items: np.ndarray) -> list[np.ndarray]:
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    at = np.searchsorted(pairs[:, 0], np.append(items, np.iinfo(np.int64).max))
    return [pairs[i:j, 1] for i, j in zip(at, at[1:], strict=False)]


def _level(t: int, tops: np.ndarray) -> tuple[int, int]:
    """The threshold whose sum over the lists, in each at most its top, reaches ``t``, and that sum."""
    tops = np.sort(tops)
    below, rest = np.concatenate([[0], np.cumsum(tops)[:-1]]), np.arange(len(tops), 0, -1)
    enough = np.flatnonzero(below + rest * tops >= t)
    level = int((t - below[enough[0]]) // rest[enough[0]]) if len(enough) else 0
    return level, int(np.minimum(tops, level).sum())


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    head: int = 64,
    b: int = 90,
    saturation: int = 8,
    most_terms: int = 500_000,
    block: int = 500_000,
) -> DataFrame:
    """The ``k`` documents of highest score above zero of each item: item_id, rank, doc_id, score.

    ``b`` (of 100) is the weight of the length, ``saturation`` that of the length's norm against the term's count.
    """
    spark = docs.sparkSession
    texts = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    id_type, item_type = docs.select(id_col).schema[0].dataType.simpleString(), texts.schema["item_id"].dataType.simpleString()
    asked = saved(texts.mapInArrow(_counted(None), f"row long, doc_id {item_type}, n long, terms array<string>, tfs array<long>").select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"), "terms"))
    wanted = asked.select("item", F.explode("terms").alias("term"))
    words = saved(wanted.select("term").distinct().select("term", F.monotonically_increasing_id().alias("id")))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0)).alias("room")).first()
    if known["n"] <= most_terms and known["room"] <= _ROOM:
        in_order = [r["term"].encode() for r in words.select("term").collect()]
        named = spark.createDataFrame([(t.decode(), i) for i, t in enumerate(in_order)], "term string, term_id long")
        counted = rows.mapInArrow(_counted({t: i for i, t in enumerate(in_order)}), f"row long, doc_id {id_type}, n long, terms array<int>, tfs array<long>")
        forward = saved(counted.select("row", "doc_id", "n", F.transform("terms", lambda t: t.cast("long")).alias("terms"), "tfs"))
    else:
        named = words.withColumnRenamed("id", "term_id")
        counted = saved(rows.mapInArrow(_counted(None), f"row long, doc_id {id_type}, n long, terms array<string>, tfs array<long>"))
        pairs = counted.select("row", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).join(named, "term")
        lists = pairs.groupBy("row").agg(F.collect_list(F.struct("term_id", "tf")).alias("x")).select("row", F.col("x.term_id").alias("terms"), F.col("x.tf").alias("tfs"))
        none = F.array().cast("array<bigint>")
        forward = saved(counted.drop("terms", "tfs").join(lists, "row", "left").select("row", "doc_id", "n", F.coalesce("terms", none).alias("terms"), F.coalesce("tfs", none).alias("tfs")))

    total = forward.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = forward.select(F.explode("terms").alias("term_id")).groupBy("term_id").agg(F.count("*").alias("df"))
    weights = saved(df.select("term_id", F.floor(1000 * F.log((2.0 * total["docs"] + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0"))
    searched = saved(wanted.join(named, "term").join(weights, "term_id").select("item", "term_id"))

    norm = F.lit(100 - b) + _div(F.lit(b * total["docs"]) * F.col("n"), F.lit(max(total["terms"], 1)))
    forward = forward.withColumn("norm", saturation * norm)
    each = forward.select("row", "norm", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("row", "norm", F.col("x.terms").alias("term_id"), F.col("x.tfs").alias("tf"))
    score = F.col("w") * _div(_SCALE * F.col("tf"), 1000 * F.col("tf") + F.col("norm"))
    postings = each.join(weights, "term_id").select("term_id", "row", score.alias("s")).where("s > 0")
    postings = saved(postings.repartitionByRange("term_id", F.desc("s")).sortWithinPartitions("term_id", F.desc("s")))
    first = Window.partitionBy("term_id").orderBy(F.desc("s"), "row")
    heads = saved(postings.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= head).drop("nth"))
    tops = saved(searched.join(heads.groupBy("term_id").agg(F.max("s").alias("top")), "term_id"))

    def of_block(searched: DataFrame, tops: DataFrame) -> DataFrame | None:
        pairs = _numbers(searched.select("item", "term_id"))
        if not len(pairs):
            return None
        items = np.unique(pairs[:, 0])
        lists = _Lists(pairs, _numbers(weights.join(searched.select("term_id"), "term_id", "left_semi").select("term_id", "w")), items)

        def by_item(rows: DataFrame, otherwise: int = 0) -> np.ndarray:
            found, values = _numbers(rows), np.full(len(items), otherwise, np.int64)
            values[np.searchsorted(items, found[:, 0])] = found[:, 1]
            return values

        def looked_up(by_row: DataFrame, least: np.ndarray) -> DataFrame:
            """Exact scores of documents for their items, from the forward table."""
            rows = forward.join(by_row, "row").select("row", "doc_id", "norm", "terms", "tfs", "items")
            return rows.mapInArrow(_exact(lists, least), f"row long, doc_id {id_type}, item long, score long")

        def bound(scores: DataFrame) -> DataFrame:
            return _best(scores, k).groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("t"))

        partial = searched.join(heads, "term_id").groupBy("item", "row").agg(F.sum("s").alias("score"))
        of_heads = _best(partial, 5 * k, "row").groupBy("row").agg(F.collect_list("item").alias("items"))
        t = by_item(bound(looked_up(of_heads, np.zeros(len(items), np.int64))))
        limits = np.array([_level(x, y) for x, y in zip(t, _by_item(_numbers(tops.select("item", "top")), items), strict=True)])
        level, reach = limits[:, 0], limits[:, 1]

        named = spark.createDataFrame(list(zip(items.tolist(), level.tolist(), strict=True)), "item long, level long")
        floor = tops.join(F.broadcast(named), "item").where("top >= level").groupBy("term_id").agg(F.min("level").alias("floor"))
        fetched = postings.join(F.broadcast(floor), "term_id").where("s >= floor").groupBy("row").agg(F.collect_list(F.struct("term_id", "s")).alias("x"))
        fetched = saved(fetched.select("row", F.col("x.term_id").alias("terms"), F.col("x.s").alias("s")))
        least = np.maximum(t, by_item(bound(fetched.mapInArrow(_partial_sums(lists, level, k), "item long, score long"))))
        candidates = fetched.mapInArrow(_candidates(lists, level, reach, least), "row long, items array<long>")
        return looked_up(candidates, least)

    size = searched.count()
    blocks = max(1, -(-size // block))
    which = F.pmod(F.xxhash64("item"), F.lit(blocks))
    parts = [x for i in range(blocks) if (x := of_block(searched.where(which == i), tops.where(which == i))) is not None]
    scores = spark.createDataFrame([], f"row long, doc_id {id_type}, item long, score long")
    for x in parts:
        scores = scores.unionByName(x)
    return _best(scores, k, "doc_id", "row").join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
