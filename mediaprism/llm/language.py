"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words padded with a
blank). A document's own list is compared with each profile by the out-of-place distance: the sum
of rank differences, with the profile's length for n-grams that a profile lacks.

The profiles are fitted on a bounded sample of the labelled rows: of each language about
``sample`` rows at most, chosen by a hash of the id, however many rows there are; rows of one id are
in it together. Predictions read every whole text.

Cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was
learned; ties between languages go to the first by name, between n-grams to the smaller code;
long texts are counted in chunks of bounded size; repeated rows give repeated rows; an empty
table gives none; of other columns only those named are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaprism.llm.common import sampled

_CHUNK = 1 << 18
_BITS = 21


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, as whole numbers in ascending order, and their counts."""
    empty = np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes + 1, 0)
    a = np.concatenate([[0], codes, [0]]).astype(np.int64)
    a = a[np.concatenate([[True], (a[1:] > 0) | (a[:-1] > 0)])]
    if len(a) < 3:
        return empty, empty
    a[a == 0] = 1  # the blank; letters start at 66
    parts = []
    for i in range(0, len(a), _CHUNK):
        x = a[i : i + _CHUNK + 2]
        own = min(_CHUNK, len(a) - i)
        one = x[:own]
        two = (x[:-1] << _BITS | x[1:])[:own]
        three = (x[:-2] << 2 * _BITS | x[1:-1] << _BITS | x[2:])[:own][x[1:-1][:own] > 1]
        parts.append(np.unique(np.concatenate([one[one > 1], two, three]), return_counts=True))
    return parts[0] if len(parts) == 1 else merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], length: int):
        self.languages, self.length = sorted(ranked), length
        self.grams = np.array(sorted({g for x in ranked.values() for g in x}), dtype=np.int64)
        self.ranks = np.full((len(self.grams), len(self.languages)), length, dtype=np.int64)
        for j, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(ranked[lang], dtype=np.int64)), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and its share of the closeness to all languages."""
        grams, counts = ngrams(text) if text else (np.zeros(0, np.int64),) * 2
        if not len(grams) or not self.languages:
            return "und", 0.0
        own = most_frequent(grams, counts, self.length)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        rank = np.arange(len(own))
        ranks = self.ranks[at[known]]
        far = np.where(ranks < self.length, np.abs(ranks - rank[known, None]), self.length).sum(axis=0) + self.length * int((~known).sum())
        close = 1 - far / (self.length * len(own))
        best = int(np.argmin(far))
        total = close.sum()
        return self.languages[best], float(close[best] / total) if total > 0 else 0.0


def fit_profiles(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000, length: int = 400) -> Profiles:
    """Profiles from rows with text and language. To the driver come ``length`` n-grams a language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return Profiles({}, length)
    share = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, min(1.0, sample / n))])
    chosen = rows.where(sampled("id", "profile", share[F.col("lang")]))

    def count(batches):
        held: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = held.setdefault(lang, [])
                parts.append(ngrams(text))
                if len(parts) >= 200:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= length).select("lang", "gram", "rank").collect()
    ranked: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of ``also``, lang_pred, score (0 to 1)."""
    rows = docs.select(F.col(id_col), *also, F.col(text_col).alias("_text"))
    kept = rows.schema[:-1]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double"])

    def predict(batches):
        for b in batches:
            found = [profiles.predict(t) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [f.name for f in kept] + ["lang_pred", "score"])

    return rows.mapInArrow(predict, schema)
