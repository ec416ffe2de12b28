"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's key is the hash of its text, so equal texts meet in one shard until it is full; whatever
a full shard cannot hold continues clockwise to the next virtual node with room. The capacities
add up to the number of rows and differ by one at most, so balance is guaranteed, and only the
overflow moves from where the plain ring would put it.

How it is distributed: a row needs its rank on its arc. Arcs are salted by a hash of the row, ranks
are taken within (arc, salt) and offset by the counts of the salts before, so an arc that holds
a third of all rows is ranked in many tasks. Only the counts per arc (shards x virtual nodes
rows) reach the driver, where the overflow is carried round the ring.

Cases: a null text counts 0 bytes plus the overhead and has checksum 0; repeated rows are rows of
their own; texts count whole, however long; rows that tie on an arc are ranked by salt, id, checksum and size, and what
still ties is alike; fewer rows than shards leave shards empty; an empty table gives no rows; columns of
the input other than id and text are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SALTED_ROWS = 250_000
#: The ring's places; the table from places to arcs has so many rows whatever the input.
PLACES = 1 << 16


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in ascending order (0 to PLACES - 1), and the shard of each."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}", seed=7) % PLACES, s) for s in range(shards) for v in range(virtual_nodes))
    return [p for p, _ in nodes], [s for _, s in nodes]


def arc_of(place: int, places: list[int]) -> int:
    """The first virtual node at or after the place; after the last one, node 0."""
    return bisect.bisect_left(places, place) % len(places)


def carry_overflow(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) that hold all counted rows.

    Arcs are filled in ring order; what does not fit goes on clockwise. A segment beyond an
    arc's first one exists only because a shard has just become full, so there are at most
    ``len(owners) + shards`` of them.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    n = len(owners)
    following: list[int] = list(range(1, n + 1))  # path-compressed links past nodes of full shards

    def with_room(node: int) -> int:
        seen = []
        while used[owners[node % n]] >= room[owners[node % n]]:
            seen.append(node % n)
            node = node % n
            step = following[node]
            node = step if step > node else node + 1
        for x in seen:
            following[x] = max(following[x], node if node > x else node + n)
        return node % n

    out = []
    for arc in sorted(counts):
        rank, node = 0, arc
        while rank < counts[arc]:
            node = with_room(node)
            s = owners[node]
            take = min(counts[arc] - rank, room[s] - used[s])
            out.append((arc, rank, rank + take, s, used[s]))
            used[s] += take
            rank += take
    return out


def assign_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, virtual_nodes: int = 64) -> DataFrame:
    """One row per document: id, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), home_shard.

    ``home_shard`` is where the ring without bounds would put the row.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, virtual_nodes)
    text = F.col(text_col)
    salts = max(16, -(-docs.count() // _SALTED_ROWS))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(PLACES)).cast("int").alias("place"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("salt")), F.lit(salts)).cast("int").alias("salt"),
    )
    arcs = spark.createDataFrame([(p, arc_of(p, places)) for p in range(PLACES)], "place int, arc int")
    rows = rows.join(F.broadcast(arcs), "place")
    w = Window.partitionBy("arc", "salt").orderBy("id", "text_crc32", "size")
    ranked = rows.withColumn("rank_in_salt", F.row_number().over(w) - 1)
    counts = rows.groupBy("arc", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    per_arc = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    parts = carry_overflow(per_arc, owners, shards) if per_arc else []
    segments = spark.createDataFrame(parts, "segment_arc int, lo long, hi long, shard int, slot_base long")
    homes = F.array(*[F.lit(s) for s in owners])
    placed = (
        ranked.join(before.select("arc", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["arc", "salt"])
        .withColumn("rank", F.col("before") + F.col("rank_in_salt"))
        .join(F.broadcast(segments), (F.col("arc") == F.col("segment_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    )
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot_base") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.element_at(homes, F.col("arc") + 1).alias("home_shard"),
    )
