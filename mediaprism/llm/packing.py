"""Packing by cutting-stock column generation.

Documents become pieces: full ones of ``capacity`` tokens and a rest; a rest above ``grain`` tokens is
cut once more, at its last multiple of ``grain``, as many long rests would leave gaps that no
short piece is there to fill. The histogram of piece
lengths, in classes of ``step`` tokens, is all that reaches the driver (capacity / step rows).
There a linear program over packing patterns is solved by column generation: its duals price a
knapsack by dynamic programming, the best new pattern enters the basis, until a dual bound shows
the rest to be worth little. Patterns are rounded down; the remaining demand is packed first-fit
decreasing in class units. On the executors the pieces of each class are ranked, and rank ranges
of the patterns give each piece its sequence.

Cases: a null or empty text is one piece with the end id alone; an empty table gives no rows;
repeated rows are packed each on its own; long texts give many full pieces; pieces of equal length tie and are ranked by
the task that read them and their order in it, which is written once and so decided; other columns are
neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.llm.common import saved
from mediaprism.llm.tokenization import word_ids


@dataclass(frozen=True)
class Plan:
    """``ranges[c]``: arrays (first rank, first sequence, pieces per sequence, first slot) by ascending rank."""

    ranges: dict[int, np.ndarray]
    sequences: int
    patterns: int
    bound: float


def best_pattern(sizes: np.ndarray, prices: np.ndarray, units: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack by dynamic programming: the pattern of highest price that fits ``units``."""
    value = np.zeros(units + 1)
    choice = np.full(units + 1, -1)
    for w in range(1, units + 1):
        k = int(np.searchsorted(sizes, w, side="right"))
        value[w] = value[w - 1]
        if k:
            found = value[w - sizes[:k]] + prices[:k]
            j = int(found.argmax())
            if found[j] > value[w] + 1e-12:
                value[w], choice[w] = found[j], j
    pattern, w = np.zeros(len(sizes), dtype=np.int64), units
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return pattern, float(value[units])


def column_generation(sizes: np.ndarray, demand: np.ndarray, units: int, gap: float = 0.001, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns in use (columns), how often the linear program takes each, and its lower bound."""
    m = len(sizes)
    basis = np.diag(units // sizes).astype(float)
    inverse = np.diag(1.0 / (units // sizes))
    level = inverse @ demand
    bound = 0.0
    for r in range(rounds):
        duals = inverse.sum(axis=0)
        pattern, price = best_pattern(sizes, np.maximum(duals, 0), units)
        bound = max(bound, float(np.maximum(duals, 0) @ demand) / max(price, 1.0))
        if price <= 1 + 1e-9 or level.sum() - bound <= gap * level.sum():
            break
        direction = inverse @ pattern
        ok = direction > 1e-9
        ratio = np.where(ok, level / np.where(ok, direction, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        level = level - ratio[out] * direction
        level[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        if r % 200 == 199:
            inverse = np.linalg.inv(basis)
            level = inverse @ demand
        level = np.maximum(level, 0)
    return basis.astype(np.int64), level, bound


def first_fit(sizes: np.ndarray, left: np.ndarray, units: int) -> list[dict[int, int]]:
    """The rounding's remains, a bounded number of pieces a class, first-fit decreasing."""
    bins: list[dict[int, int]] = []
    room = np.zeros(int(left.sum()) + 1, dtype=np.int64)
    for j in np.argsort(-sizes):
        for _ in range(int(left[j])):
            k = int(np.argmax(room[: len(bins)] >= sizes[j])) if bins else 0
            if not bins or room[k] < sizes[j]:
                k = len(bins)
                bins.append({})
                room[k] = units
            bins[k][j] = bins[k].get(j, 0) + 1
            room[k] -= sizes[j]
    return bins


def plan(histogram: dict[int, int], units: int) -> Plan:
    """Solve the cutting-stock problem for so many pieces of each class (in units)."""
    if not histogram:
        return Plan({}, 0, 0, 0.0)
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    columns, level, bound = column_generation(sizes, demand, units)
    left = demand.copy()
    used: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-level):
        pattern = {int(j): int(columns[j, k]) for j in np.nonzero(columns[:, k])[0]}
        times = int(min([int(level[k] + 1e-6), *(left[j] // n for j, n in pattern.items())]))
        if times > 0:
            used.append((pattern, times))
            for j, n in pattern.items():
                left[j] -= n * times
    used += [(b, 1) for b in first_fit(sizes, left, units)]
    ranges: dict[int, list] = {int(s): [] for s in sizes}
    rank = np.zeros(len(sizes), dtype=np.int64)
    sequence = 0
    for pattern, times in used:
        slot = 0
        for j in sorted(pattern, reverse=True):
            ranges[int(sizes[j])].append((rank[j], sequence, pattern[j], slot))
            rank[j] += pattern[j] * times
            slot += pattern[j]
        sequence += times
    return Plan({c: np.array(r, dtype=np.int64) for c, r in ranges.items()}, sequence, len(used), bound)


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, capacity: int, grain: int, step: int, end_id: int) -> DataFrame:
    """Pieces with their class, the task that made them and their number in (task, class)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "cls", "task", "nth"]

    def cut(batches):
        from pyspark import TaskContext

        words, task, seen = word_ids(tokenizer), TaskContext.get().partitionId(), [0] * (-(-capacity // step) + 1)
        for b in batches:
            out: list[list] = [[] for _ in names]
            take = []
            for k, text in enumerate(b.column(1)):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                last = n - n % capacity
                cuts = [*range(0, last, capacity), last, *({last + (n - last) // grain * grain} - {last, n})]
                for start, stop in zip(cuts, [*cuts[1:], n], strict=True):
                    length = stop - start
                    if not length:
                        continue
                    c = -(-length // step)
                    take.append(k)
                    for x, v in zip(out[1:], (start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, c, task, seen[c]), strict=True):
                        x.append(v)
                    seen[c] += 1
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(x, t) for x, t in zip(out[1:], kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int, task int, nth long")


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, grain: int = 1024, step: int = 8, end_id: int = 2) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # The numbers in (task, class) depend on how rows were read; written, they stay as they are.
    pieces = saved(tokenized_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, grain=grain, step=step, end_id=end_id))
    counts = pieces.groupBy("cls", "task").agg(F.count("*").alias("n"))
    histogram = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    ranges = plan(histogram, -(-capacity // step)).ranges
    earlier = counts.select("cls", "task", F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["cls", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))

    def place(batches):
        for b in batches:
            cls, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (5, 6))
            sequence, slot = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for c in np.unique(cls):
                at = np.nonzero(cls == c)[0]
                r = ranges[int(c)]
                k = r[np.searchsorted(r[:, 0], rank[at], side="right") - 1]
                over = rank[at] - k[:, 0]
                sequence[at], slot[at] = k[:, 1] + over // k[:, 2], k[:, 3] + over % k[:, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(slot)], [*b.schema.names[:5], "sequence_id", "slot"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank").mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"))
