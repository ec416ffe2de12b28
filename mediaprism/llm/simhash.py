"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is 1 if more than half the hashes of the document's word shingles have it. Equal
fingerprints are one class. To link classes at ``radius`` bits or fewer, the 64 bits are dealt into m
partitions, correlated bits together, with thresholds t that may differ: if their sum is
radius - m + 1, two linked fingerprints differ by at most t bits in some partition. Dynamic
programming chooses the thresholds, over every m, by estimated rows to probe and pairs to verify;
the estimate comes from a bounded sample and decides only the cost, never the result. Every
fingerprint goes to the bucket of its value in each partition and, where t > 0, to those nearby;
in a bucket all pairs are verified in blocks, but only the links of a spanning forest leave it.
A bucket beyond ``bucket_rows`` is dealt again by further bits, and what is still beyond it into
blocks, pairs of which are verified apart.

Cases: texts without words have fingerprint zero and are one class; fewer words than a shingle
count whole; null texts are empty; repeated rows give repeated rows; different texts under one id are
rows of their own, which are grouped by their fingerprints alone; very long texts are hashed whole
(64 bytes a word while they are); an empty table gives none; columns other than those named are not
read. Ids are comparable values; ties do not arise, as a component is named by its smallest id. A row
without an id has a fingerprint and shares its class's component, which is null if no row of it has one.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaprism.llm.common import sampled, saved, text_key
from mediaprism.llm.components import components

#: What verifying a pair costs against shipping one probe row.
_PAIR_COST = 0.02


def simhash(text: str | None, shingle: int = 4) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    start = np.concatenate([[0], ends[: n - 1]]).tolist()
    stop = (ends[len(words) - n :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], 42) for a, b in zip(start, stop, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp (the 64 bits as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def correlated_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Bits dealt into m partitions of nearly equal width, each filled with the bits most correlated with it."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(float) - bits.mean(axis=0)
    norm = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    left, groups = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            group.append(best := max(left, key=lambda b: corr[b, group].sum()))
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost for n fingerprints."""
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    best_cost, best = float("inf"), []
    for m in range(1, radius + 2):
        groups = correlated_groups(sample, m) if len(sample) > 1 else [list(range(i, 64, m)) for i in range(m)]
        costs = []
        for g in groups:
            mask = np.uint64(sum(1 << b for b in g))
            near = np.zeros(radius + 1)
            for i in range(0, len(sample), 256):
                d = np.bitwise_count((sample[i : i + 256, None] ^ sample[None, :]) & mask)
                near += [(d <= t).sum() for t in range(radius + 1)]
            near = np.maximum((near - len(sample)) / 2 / pairs, [sum(comb(len(g), j) for j in range(t + 1)) / 2.0 ** len(g) for t in range(radius + 1)])
            costs.append([0.0] + [n * sum(comb(len(g), j) for j in range(t + 1)) + _PAIR_COST * near[t] * n * n / 2 for t in range(radius + 1)])
        # table[s]: least cost and thresholds whose (t + 1) add up to s; the sum wanted is radius + 1.
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            table = {s: min((table[s - x][0] + c[x], [*table[s - x][1], x - 1]) for x in range(s + 1) if s - x in table and x < len(c)) for s in range(radius + 2) if any(s - x in table for x in range(min(s + 1, len(c))))}
        if radius + 1 in table and table[radius + 1][0] < best_cost:
            best_cost, best = table[radius + 1][0], [(g, t) for g, t in zip(groups, table[radius + 1][1], strict=True) if t >= 0]
    return best


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of a spanning forest of all links within ``radius``."""
    n, linked = len(fps), []
    for i in range(0, n, 512):
        linked.append((np.bitwise_count(fps[i : i + 512, None] ^ fps[None, :]) <= radius).sum(axis=1) > 1)
    left = np.nonzero(np.concatenate(linked))[0] if n else np.zeros(0, int)
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            part, front = front[:256], front[256:]
            near = np.bitwise_count(fps[left][:, None] ^ fps[part][None, :]) <= radius
            hit = near.any(axis=1)
            a.append(part[near[hit].argmax(axis=1)])
            b.append(left[hit])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int),) * 2


def near_links(classes: DataFrame, *, radius: int = 4, sample: int = 3000, bucket_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are linked.

    ``classes``: fp (distinct).
    """
    n = classes.count()
    chosen = classes.where(sampled("fp", "sample", F.lit(min(1.0, sample / max(1, n))))).select("fp").collect()
    parts = allocate(np.array([r["fp"] for r in chosen], dtype=np.int64).view(np.uint64), n, radius)
    masks = [np.uint64(sum(1 << b for b in g)) for g, _ in parts]
    flips = [np.array([0] + [sum(1 << b for b in bits) for j in range(1, t + 1) for bits in itertools.combinations(g, j)], dtype=np.uint64) for g, t in parts]

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (mask, flip) in enumerate(zip(masks, flips, strict=True)):
                step = max(1, 100_000 // len(flip))
                for i in range(0, len(fp), step):
                    own = fp[i : i + step]
                    key = ((own & mask)[:, None] ^ flip[None, :]).ravel()
                    at = np.repeat(np.arange(i, i + len(own)), len(flip))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(fp[at].view(np.int64))], ["part", "key", "fp"])

    rows = classes.select("fp").mapInArrow(deal, "part int, key long, fp long").select("part", "key", F.lit("").alias("block"), "fp")
    for split in (_by_further_bits(parts, radius), _by_pairs_of_blocks(bucket_rows)):
        bucket = ["part", "key", "block"]
        hot = saved(rows.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > bucket_rows))
        if hot.limit(1).count():
            marked = rows.join(hot, bucket, "left")
            more = F.when(F.col("size").isNull(), F.array(F.lit(""))).otherwise(split)
            rows = marked.withColumn("more", F.explode(more)).select("part", "key", F.concat("block", "more").alias("block"), "fp")

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def links(t: pa.Table, whole: bool):
            """Links of the buckets of ``t``, which are in order; and where the last one begins, if more of it may come."""
            part, key = (t.column(c).to_numpy() for c in (0, 1))
            block = t.column(2).combine_chunks().dictionary_encode().indices.to_numpy()
            fp = t.column(3).to_numpy().view(np.uint64)
            new = np.nonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1]))[0] + 1
            edges = np.concatenate([[0], new, [len(part)]])
            last = len(edges) - 1 if whole else len(edges) - 2
            a, b = [], []
            for i in np.nonzero(np.diff(edges[: last + 1]) > 1)[0]:
                x, y = forest(fp[edges[i] : edges[i + 1]], radius)
                if len(x):
                    a.append(fp[x + edges[i]])
                    b.append(fp[y + edges[i]])
            out = [pa.array((np.concatenate(z) if z else np.zeros(0, np.uint64)).view(np.int64)) for z in (a, b)]
            return pa.RecordBatch.from_arrays(out, ["a", "b"]), int(edges[last])

        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= 50_000:
                t = pa.Table.from_batches(held)
                found, begin = links(t, False)
                yield found
                held = t.slice(begin).to_batches()
                rows_held = t.num_rows - begin
        if held:
            yield links(pa.Table.from_batches(held), True)[0]

    dealt = rows.repartition("part", "key", "block").sortWithinPartitions("part", "key", "block")
    return dealt.mapInArrow(verify, "a long, b long").where("a <> b")


def _by_further_bits(parts: list[tuple[list[int], int]], radius: int):
    """For a bucket's rows, to which buckets inside it they go.

    Two linked fingerprints of a bucket differ by ``radius`` bits at most outside its partition as well, so
    of radius + 1 groups of the other bits they share one.
    """
    masks = []
    for g, _ in parts:
        other = [b for b in range(64) if b not in g]
        groups = [sum(1 << b for b in other[i :: radius + 1]) for i in range(radius + 1)]
        masks.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in groups]))
    own = F.element_at(F.array(*masks), F.col("part") + 1)
    return F.transform(own, lambda m, i: F.concat_ws(":", i.cast("string"), F.col("fp").bitwiseAND(m).cast("string")))


def _by_pairs_of_blocks(bucket_rows: int):
    """A bucket that is large even so is dealt into blocks, and each pair of them is verified apart."""
    blocks = F.ceil(F.col("size") / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit("block")), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws("-", F.lit("/"), F.least(j, mine), F.greatest(j, mine)))


def fingerprint_groups(rows: DataFrame, *, radius: int = 4, **options) -> DataFrame:
    """Of rows with an ``fp``: class_fp and group, a fingerprint that names all those it is linked with; one row per fingerprint."""
    classes = saved(rows.select(F.col("fp").alias("fp")).distinct())
    linked = components(near_links(classes, radius=radius, **options))
    return classes.join(linked, classes["fp"] == linked["node"], "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, **options) -> DataFrame:
    """One row per document: id, fp, component_id."""
    rows = saved(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    groups = saved(fingerprint_groups(rows, radius=radius, **options))
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    named = groups.join(least, groups["class_fp"] == least["fp"]).select("class_fp", "group", "least")
    firsts = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "group").select("class_fp", "component_id")
    return rows.join(named, rows["fp"] == named["class_fp"]).select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of least id stays, of equal ids the one of least text key.

    Rows without an id come after those with one. Rows that agree in id and text are one document, of which one
    row stays. All columns are kept.
    """
    plain = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).alias("name"), F.col(text_col).alias("text"))
    rows = saved(fingerprints(plain, id_col="name", text_col="text", shingle=shingle))
    groups = fingerprint_groups(rows, radius=radius, **options)
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    kept = groups.join(least, groups["class_fp"] == least["fp"]).groupBy("group").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.id").alias("__nd_id"), F.col("least.key").alias("__nd_key"))
    rest = docs.withColumn("__nd_own", text_key(F.col(text_col)))
    found = rest.join(kept, F.col(id_col).eqNullSafe(F.col("__nd_id")) & (F.col("__nd_own") == F.col("__nd_key")), "left_semi")
    return found.dropDuplicates([id_col, "__nd_own"]).select(*docs.columns)
