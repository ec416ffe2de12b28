"""Line dedup by winnowing over line hashes.

Lines are the text's lines, cut further at sentence ends, as passages are also repeated inside longer
lines. A line of more than ``LONG`` words is cut once more, before the word that sorts first in each ``CUT``
consecutive ones; so what two texts share inside long lines is cut alike in both, wherever it begins there.
Any span of words that two texts share holds common whole lines but for ``2 * CUT - 2`` words at either
end. A run is the shortest sequence of whole lines from one on that has ``min_words`` words: a shared span of
51 words always holds a run of 25.

The gram of a line is the shortest sequence of lines from there with ``gram_words`` words. Of the grams inside a run
the one of smallest hash is selected: the winnowing fingerprint. Equal runs select the same gram, so
each repeated run holds a fingerprint that occurs twice at least. Their positions are joined to find these; around them
matches are extended both ways, line by line: every run that selects such a fingerprint is joined with the
position where it occurs first, by (id, row, line). The result is exact: a line goes if and only
if it lies in a run that occurs earlier too. The first occurrence of anything stays. Runs are told apart by
128 bits.

What is shuffled are hashes and positions; texts are read where they lie. Fingerprints and runs are
counted by partial aggregation and met by joins that Spark may split, so a passage in a third of all documents
is no hot group.

Cases: null and empty texts have no lines; a row that repeats another's id and text is the same
document and is treated alike; of different texts under one id the one read first comes first; runs of one
text may repeat each other, the first stays; rows without an id come first; of a very long text
(24 bytes a word, and 256 KB of it at a time while it is hashed) there is one array of hashes; an empty table
gives none; other columns are untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaprism.llm.common import saved, text_key

#: Of so many consecutive words of a long line one begins a new line.
CUT = 7
#: Lines of more words are long. A span's end in a line that is not may lose so many words, as in one that is.
LONG = 2 * CUT - 2
_BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PLACE_BITS = np.uint64(28)
_SPAN = 1 << 18
_SPACE, _BREAK, _DOT = b" \n."


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a UTF-8 text in bytes, and how many each sentence has.

    Words stand between spaces and line breaks. A sentence ends at a line break and after a word that ends in a
    full stop before a space; its last word's full stops are not part of it.
    """
    apart = (raw == _SPACE) | (raw == _BREAK)
    edge = np.diff(np.concatenate([[True], apart, [True]]).view(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64)
    breaks = np.searchsorted(np.nonzero(raw == _BREAK)[0], starts)
    last = np.append(breaks[1:] > breaks[:-1], True) | (raw[ends - 1] == _DOT)
    dotted = np.nonzero(last & (raw[ends - 1] == _DOT))[0]
    for k in range(4):
        ends[dotted] -= 1
        dotted = dotted[(ends[dotted] > starts[dotted]) & (raw[ends[dotted] - 1] == _DOT)]
    for i in dotted:
        ends[i] = starts[i] + len(raw[starts[i] : ends[i]].tobytes().rstrip(b"."))
    sentence = np.cumsum(last) - last
    some = ends > starts
    starts, ends, sentence = starts[some], ends[some], sentence[some]
    first = np.nonzero(np.diff(sentence, prepend=-1))[0]
    return starts, ends, np.diff(np.append(first, len(sentence)))


def sort_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number, in the order of the words as strings of bytes."""
    at = starts[:, None] + np.arange(8)
    return np.where(at < ends[:, None], raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8).view(">u8").ravel().astype(np.uint64)


def cuts(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where lines begin, in words: of sentences of so many words each, and inside the long ones."""
    ends = np.cumsum(sizes)
    begins = np.zeros(len(keys), bool)
    begins[ends - sizes] = True
    # Starts of windows that lie in one long line.
    at = np.nonzero(np.repeat(np.where(sizes > LONG, ends, 0), sizes) >= np.arange(CUT, len(keys) + CUT))[0]
    if len(at):
        begins[at + np.lib.stride_tricks.sliding_window_view(keys, CUT)[at].argmin(axis=1)] = True
    return np.nonzero(begins)[0]


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts, one text after another, hash and number of words; and where each text's lines begin, and end."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends, sizes = words_of(raw)
    hashes, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN)))
        hashes[i:j] = run_hashes(raw[starts[i] : ends[j - 1]].astype(np.uint64), starts[i:j] - starts[i], ends[i:j] - starts[i], _BASES[0])
        i = j
    begin = cuts(sort_keys(raw, starts, ends), sizes) if len(starts) else starts
    end = np.append(begin[1:], len(hashes)) if len(begin) else begin
    first = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return run_hashes(hashes, begin, end, _BASES[1]), end - begin, np.searchsorted(starts[begin], first)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the numbered lines; where all between two line breaks goes, no line break is left."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends, sizes = words_of(np.frombuffer(raw, np.uint8))
    begin = starts[cuts(sort_keys(np.frombuffer(raw, np.uint8), starts, ends), sizes)].tolist() if len(starts) else []
    out, at, n = [], 0, 0
    for row in raw.split(b"\n"):
        end = at + len(row)
        mine = []
        while n + len(mine) < len(begin) and begin[n + len(mine)] < end:
            mine.append(begin[n + len(mine)])
        spans = list(zip(mine, [*mine[1:], end][: len(mine)], strict=True))
        left = [(s, e) for i, (s, e) in enumerate(spans, n) if i not in gone]
        if len(left) == len(mine):
            out.append(row)
        elif left:
            kept = b"".join(raw[s:e] for s, e in left)
            out.append(kept if left[-1][1] == end else kept.rstrip())
        at, n = end + 1, n + len(mine)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def shortest_runs(words: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest run from each line on, where there is one in its text.

    ``bounds``: where each text's lines begin, and the end.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    end = np.searchsorted(total, total[:-1] + min_words, side="left")
    start = np.nonzero(end <= np.repeat(bounds[1:], np.diff(bounds)))[0]
    return start, end[start]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, from 1 to n and from 0 to n; up to half a million are kept."""
    up, down = _POWERS.get(base, (np.zeros(0, np.uint64),) * 2)
    if len(up) < n:
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(max(n, 1024), np.uint64(base)))
            down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(up), np.uint64(pow(base, -1, 1 << 64))))])
        if len(up) <= 1 << 19:
            _POWERS[base] = up, down
    return up[:n], down[: n + 1]


def run_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run's hashes in order, wherever the run stands."""
    with np.errstate(over="ignore"):
        power, back = powers(base, len(hashes))
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power, out=total[1:])
        x = (total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)
        x ^= x >> np.uint64(31)
        return x * np.uint64(base)


def selected(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int, gram_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs, the line whose gram each selects, and the gram of every line."""
    start, end = shortest_runs(words, bounds, min_words)
    if not len(start):
        return start, end, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if len(words) >> int(_PLACE_BITS):
        raise ValueError(f"a text of {len(words)} lines; at most 2^{_PLACE_BITS} can be numbered")
    until = np.searchsorted(total, total[:-1] + gram_words, side="left")  # beyond the text's end where it has no gram
    grams = run_hashes(hashes, np.arange(len(words)), np.minimum(until, len(words)), _BASES[0])
    last = np.searchsorted(until, end, side="right")
    marked = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(words), dtype=np.uint64)
    low = np.minimum.reduceat(np.append(marked, np.uint64(2**64 - 1)), np.stack([start, last], axis=1).ravel())[::2]
    return start, end, (low & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64), grams


def winnow(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, min_words: int, gram_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines whose gram is selected by at least one run, and the gram's hash."""
    _, _, place, grams = selected(hashes, words, bounds, min_words, gram_words)
    place = np.unique(place)
    return place, grams[place]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _whole(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, one list after another, and where each begins, and the end."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, gram_words: int = 12) -> DataFrame:
    """id, key (of the text), n_lines, n_words, gone (numbers of the lines to delete), gone_words; one row per id and text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "key", "n_lines", "n_words", "hashes", "words", "places", "marks"]

    def read(batches):
        for b in batches:
            size, at = pa.compute.fill_null(pa.compute.binary_length(b.column(3)), 0).to_numpy(), 0
            for part in np.split(np.arange(b.num_rows), np.nonzero(np.diff(np.cumsum(size) // _SPAN))[0] + 1):
                rows = b.slice(at, len(part))
                at += len(part)
                h, w, bounds = lines_of(rows.column(3).to_pylist())
                place, mark = winnow(h, w, bounds, min_words, gram_words)
                own = np.searchsorted(place, bounds)
                total = np.concatenate([[0], np.cumsum(w)])[bounds]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(np.diff(bounds)), pa.array(np.diff(total)), _lists(h.view(np.int64), bounds), _lists(w.astype(np.int8), bounds), _lists((place - np.repeat(bounds[:-1], np.diff(own))).astype(np.int32), own), _lists(mark.view(np.int64), own)],
                    names,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    # The row's number depends on how rows were read; written, it stays as it is.
    lines = saved(rows.mapInArrow(read, f"row long, id {kind}, key string, n_lines long, n_words long, hashes array<long>, words array<tinyint>, places array<int>, marks array<long>"))

    marks = lines.select("row", F.explode(F.arrays_zip("places", "marks")).alias("m")).select("row", F.col("m.places").alias("place"), F.col("m.marks").alias("mark"))
    # Written, it meets the marks in a join of two plain exchanges, of which Spark can split a hot mark's side.
    twice = saved(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    # Which fingerprints of a document occur twice; then the document's lines come to them.
    near = marks.join(twice, "mark", "left_semi").groupBy("row").agg(F.collect_set("place").alias("near"))
    near = near.join(lines.select("row", "id", "hashes", "words"), "row")

    def extend(batches):
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            (h, bounds), (w, _), (marked, own) = (_whole(b.column(i)) for i in (3, 4, 2))
            h = h.view(np.uint64)
            twice_there = np.zeros(len(h) + 1, bool)
            twice_there[marked + np.repeat(bounds[:-1], np.diff(own))] = True
            s, e, place, _ = selected(h, w, bounds, min_words, gram_words)
            s, e = s[twice_there[place]], e[twice_there[place]]
            of = np.searchsorted(bounds, s, side="right") - 1
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in b.columns[:2]), *(pa.array(run_hashes(h, s, e, base).view(np.int64)) for base in _BASES), *(pa.array((x - bounds[of]).astype(np.int32)) for x in (s, e))],
                ["row", "id", "run", "run2", "start", "end"],
            )

    runs = saved(near.select("row", "id", "near", "hashes", "words").mapInArrow(extend, f"row long, id {kind}, run long, run2 long, start int, end int"))
    first = saved(runs.groupBy("run", "run2").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "start")).alias("first")).where("n > 1").select("run", "run2", F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")))
    later = runs.join(first, ["run", "run2"]).where("row <> first_row OR start <> first_start")
    gone = later.groupBy(F.col("row").alias("gone_row")).agg(F.collect_set(F.struct("start", "end")).alias("runs")).select("gone_row", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["end"] - 1))))).alias("gone"))
    of = lines.select(F.col("row").alias("gone_row"), "words")
    gone = gone.join(of, "gone_row").select("gone_row", "gone", F.aggregate(F.transform("gone", lambda i: F.element_at("words", i + 1)), F.lit(0).cast("long"), lambda a, v: a + v).alias("gone_words"))
    # Rows that agree in id and text are one document: the first of them says what goes.
    named = lines.groupBy("id", "key").agg(F.min("row").alias("row"), F.max("n_lines").alias("n_lines"), F.max("n_words").alias("n_words"))
    found = named.join(gone, F.col("row") == F.col("gone_row"), "left")
    return found.select("id", "key", "n_lines", "n_words", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.coalesce("gone_words", F.lit(0).cast("long")).alias("gone_words"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with later repeated runs deleted from the text; all columns kept, in order.

    A document of which nothing is left goes.
    """
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, **options).where(F.size("gone") > 0).select(F.col("id").alias("__ld_id"), F.col("key").alias("__ld_key"), F.col("gone").alias("__ld_gone"))
    rows = docs.withColumn("__ld_own", text_key(F.col(text_col)))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("__ld_id")) & (F.col("__ld_own") == F.col("__ld_key")), "left")

    @F.pandas_udf("string")
    def without(text, gone):
        return type(text)([t if t is None or g is None or not len(g) else without_lines(t, set(map(int, g))) for t, g in zip(text, gone, strict=True)], dtype=object)

    # Python gets the texts of documents that lose something only.
    changed = F.when(F.col("__ld_gone").isNotNull(), without(F.when(F.col("__ld_gone").isNotNull(), F.col(text_col)), F.col("__ld_gone"))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, changed).where(F.col("__ld_gone").isNull() | (F.trim(text_col) != "")).select(*docs.columns)


def brute_force(rows: list[tuple], min_words: int = 25) -> dict[tuple, list[int]]:
    """Deleted lines of (id, text) rows by comparing all runs; for small fixtures."""
    lines = {}
    for i, t in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        mine = []
        for part in re.split(r"\n|(?<=\.) ", t or ""):
            if w := part.rstrip(" .").split():
                first = lambda s: min(range(s, s + CUT), key=lambda k: (w[k].encode()[:8].ljust(8, b"\0"), k))  # noqa: E731, B023
                begin = sorted({0} | ({first(s) for s in range(len(w) - CUT + 1)} if len(w) > LONG else set()))
                mine += [tuple(w[a:b]) for a, b in zip(begin, [*begin[1:], len(w)], strict=True)]
        lines[i, t] = mine
    seen, gone = {}, {k: set() for k in lines}
    for key, u in lines.items():
        for s in range(len(u)):
            e = next((e for e in range(s, len(u)) if sum(map(len, u[s : e + 1])) >= min_words), None)
            if e is not None and seen.setdefault(tuple(u[s : e + 1]), (key, s)) != (key, s):
                gone[key].update(range(s, e + 1))
    return {k: sorted(v) for k, v in gone.items()}
