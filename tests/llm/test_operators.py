"""The ten operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import io
import random
import re
import struct
import unicodedata
import wave
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediaprism.llm import chat, decontamination, language, line_dedup, media_columns, packing, queries, sharding, simhash, token_counts, tokenization, toxicity
from mediaprism.llm.components import components

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, rank int, words int, task int, arc int, fp int, node int, _text string, version int, gone int"
ODD = [None, "", " \n\t ", "a", "The same text twice. And more.", "The same text twice. And more.", "<|endoftext|> x <|startoftext|>", "don't  we'll\n\n  STOP ñandú ß İ 漢字 🙂 \x1c", "x" * 3000, "la " * 3000, "idiot " * 9]


def odd(spark, texts=ODD):
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, ODD[4])]
    return spark.createDataFrame([(*r, *("c" if i in (2, 9) else 1 for i in range(2, 12))) for r in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- 1, 4: tokens and packing


def check_packing(pieces, rows):
    tok = Tokenizer.from_file(WORDS)
    spans, order = {}, {}
    for p in pieces:
        spans.setdefault(p["doc_id"], []).append(p)
        order.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    seen = Counter(i for i, _ in rows)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted(spans[i], key=lambda p: p["start"])
        assert sum(p["length"] for p in mine) == len(ids) * seen[i] and all(p["doc_tokens"] == len(ids) for p in mine)
        for p in mine:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for s in order.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(p["length"] for p in pieces) / (4096 * len(order))


def test_packing_places_each_token_once_with_little_padding(spark):
    rows = [(i * 10 + k, t) for i, t in texts_of(spark) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert check_packing(packing.pack(docs, WORDS).collect(), rows) > 0.98


def test_packing_of_odd_rows(spark):
    docs = odd(spark)
    check_packing(packing.pack(docs, WORDS).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack(none(spark), WORDS).count() == 0


def test_plan_covers_the_demand_near_its_bound():
    rnd = random.Random(3)
    h = Counter(rnd.choice([rnd.randint(1, 60), rnd.randint(100, 300), 512]) for _ in range(5000))
    p = packing.plan(dict(h), 512)
    for c, n in h.items():
        r = p.ranges[c]
        assert r[0, 0] == 0 and (np.diff(r[:, 0]) > 0).all() and r[-1, 0] < n
    assert p.bound <= p.sequences <= sum(c * n for c, n in h.items()) / 512 * 1.02 + 2


def test_tokenizers_agree_with_the_library():
    words, count = tokenization.WordIds(WORDS, room=20_000), tokenization.ByteCounts(BYTES, room=20_000)
    wl, bl = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    rnd = random.Random(1)
    alphabet = [chr(i) for i in range(1, 0x250)] + list(" \n\t  'sdm") * 20 + list("ßİſKÅééẞ  　漢字🙂١²½Ⅷ\x85\x1c") * 8
    some = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for t in [*(t or "" for t in ODD), *some, "A'S 'll", " " * 40 + "a", "a  \n b", "a<|endoftext|> b"]:
        ids = wl.encode(t, add_special_tokens=False).ids
        assert words.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert count.count(t) == len(bl.encode(t, add_special_tokens=False).ids)


def test_counts_of_characters_that_one_table_lacks():
    """All code points, and those that this interpreter's pattern takes for letters and the library does not."""
    count, lib = tokenization.ByteCounts(BYTES), Tokenizer.from_file(BYTES)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    known = [c for c in every if unicodedata.category(c) != "Cn"]
    for i in range(0, len(known), 500):
        text = "".join(f"a{c}1{c}{c} {c}'ll" for c in known[i : i + 500])
        assert count.split(text) == [text[a:b] for _, (a, b) in count.pre.pre_tokenize_str(text)]
    rnd = random.Random(6)
    texts = ["\U000325df'll", "\u0558a", "a\ua7ce 1", "\U00018e00 y"] + ["".join(rnd.choice(every) + rnd.choice(["", " ", "a", "1", "'ll"]) for _ in range(12)) for _ in range(1500)]
    assert [count.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_what_is_kept_is_bounded_in_bytes():
    words = tokenization.WordIds(WORDS, room=1 << 16)
    words.encode(" ".join("x" * (i % 300) + str(i) for i in range(20_000)))
    held = [k for d in (words.chunks, words.words) for k in d]
    assert max(map(len, held)) <= 64 and sum(map(len, held)) < 1 << 16
    words.encode("y" * 3_000_000)
    assert len([k for d in (words.chunks, words.words) for k in d]) == len(held)


def test_words_are_encoded_once_whatever_stands_beside_them():
    """Many words, each beside other signs each time: chunks that are all different, of words that are not."""
    words, asked = tokenization.WordIds(WORDS), []
    find = words.words.find
    words.words.find = lambda word: asked.append(word) or find(word)
    some = ["".join("abcdefghij"[int(d)] for d in f"{i:05d}") for i in range(60_000)]
    texts = [" ".join(f"{w}{sign}" for w in some) for sign in (".", ",", "!?", "(x)")]
    library = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [words.encode(t) for t in texts] == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library]
    assert len(asked) == len(set(asked)) <= len(some) + 6


def test_plain_letters_and_digits_are_those_of_the_pattern():
    words, library = tokenization.WordIds(WORDS), Tokenizer.from_file(WORDS)
    plain = [chr(i) for i in [9, 10, 13, *range(32, 127), *range(0xA1, 0x100)]]
    for a in plain:
        for text in (f"x{a}y{a}{a}1{a}'s{a} {a}", "".join(f"{a}{b}" for b in plain)):
            ids = library.encode(text, add_special_tokens=False).ids
            assert words.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_merging_pops_the_lowest_rank_first():
    ranks = {("a", "b"): (1, "ab"), ("b", "c"): (0, "bc"), ("a", "bc"): (2, "abc")}
    assert tokenization.merged_length(list("abc"), ranks) == 1 and tokenization.merged_length(list("aab"), ranks) == 2 and tokenization.merged_length([], ranks) == 0


def test_token_counts(spark):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(odd(spark), BYTES).collect()}
    tok = Tokenizer.from_file(BYTES)
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(none(spark), BYTES).count() == 0


# --- 2: sharding


def test_sharding_is_balanced_and_moves_only_overflow(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(4003)] + [(-1, None), (-1, None)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    per = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["size"] == len("text 1") + 16 and one["text_crc32"] == zlib.crc32(b"text 1") and one["grown_shard"] is None
    assert sharding.assign_shards(none(spark), 40).count() == 0
    assert sharding.assign_shards(odd(spark), 40).count() == len(ODD) + 1


def test_the_ring_walked_row_by_row(spark):
    """Rows one after another, in the order of their arcs and ranks, each to the first virtual node at or after its place whose shard has room."""
    shards, nodes = 6, 8
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(900)] + [(None, "no id"), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(docs, shards, virtual_nodes=nodes).collect()
    places, owners = sharding.ring(shards, nodes)
    placed = {r["text"]: r["place"] for r in docs.select("text", F.pmod(F.xxhash64("text"), F.lit(sharding.PLACES)).alias("place")).distinct().collect()}
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = {t: next((n for n in range(len(places)) if places[n] >= p), 0) for t, p in placed.items()}
    want = Counter()
    for text in sorted((t for _, t in rows), key=lambda t: arcs[t]):
        node = arcs[text]
        while not room[owners[node % len(owners)]]:
            node += 1
        room[owners[node % len(owners)]] -= 1
        want[arcs[text], owners[node % len(owners)]] += 1
    crc = {zlib.crc32((t or "").encode()): arcs[t] for t in placed}
    assert Counter((crc[r["text_crc32"]], r["shard"]) for r in got) == want
    assert all(r["home_shard"] == owners[crc[r["text_crc32"]]] for r in got) and sum(r["shard"] != r["home_shard"] for r in got) < len(rows) / 2
    long = spark.createDataFrame([(1, "x" * 3_000_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert [r["size"] for r in sharding.assign_shards(long, 2).collect()] == [3_000_016] * 2


def test_overflow_goes_clockwise():
    parts = sharding.carry_overflow({0: 5, 1: 1}, [0, 1, 2], 3)
    assert parts == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 0), (1, 0, 1, 2, 1)]


# --- 3, 5: language and toxicity


def test_language_on_held_out_rows(spark):
    rows = queries.op3_language(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = rows.join(lang, "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.9


def brute_ngrams(text):
    """Counts of 1 to 3 letters of words padded with a blank, which counts in no n-gram of its own."""
    flat = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    flat = re.sub(" +", " ", flat)
    n = Counter(c for c in flat if c != " ")
    n.update(flat[i : i + 2] for i in range(len(flat) - 1))
    n.update(flat[i : i + 3] for i in range(len(flat) - 2) if flat[i + 1] != " ")
    return n


def coded(gram):
    """An n-gram as the number the module uses for it: blanks are 1, letters follow their code points."""
    value = 0
    for c in gram:
        value = value << 21 | (1 if c == " " else ord(c) + 1)
    return value


def test_distances_by_definition(spark):
    """Profiles and predictions against out-of-place distances computed one by one, on the whole of the smallest table."""
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()]
    rows = [(i, lang, t[:1500]) for i, lang, t in rows if t][:60] + [(1000, "aa", "ab ab ab"), (1001, "bb", "ba ba ba"), (1002, "aa", None), (1003, None, "zz")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, score string, gram int")
    p = language.fit_profiles(docs, length=50)
    counts = {}
    for _, lang, text in rows:
        if lang and text:
            counts.setdefault(lang, Counter()).update(brute_ngrams(text))
    ranked = {lang: [g for g, _ in sorted(((coded(g), n) for g, n in c.items()), key=lambda x: (-x[1], x[0]))[:50]] for lang, c in counts.items()}
    assert p.languages == sorted(ranked)
    for r in language.identify(docs, p).collect():
        text = next(t for i, _, t in rows if i == r["doc_id"])
        if not text or not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und"
            continue
        own = [g for g, _ in sorted(((coded(g), n) for g, n in brute_ngrams(text).items()), key=lambda x: (-x[1], x[0]))[:50]]
        far = {lang: sum(abs(k - x.index(g)) if g in x else 50 for k, g in enumerate(own)) for lang, x in ranked.items()}
        close = {lang: 1 - d / (50 * len(own)) for lang, d in far.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and abs(r["score"] - (close[best] / sum(close.values()) if sum(close.values()) else 0)) < 1e-9


def test_language_of_a_very_long_text(spark):
    p = language.Profiles({"x": [coded("a"), coded("ab")], "y": [coded("b")]}, 5)
    assert p.predict("ab " * 1_000_000)[0] == "x"


def test_language_of_odd_rows(spark):
    p = language.Profiles({"x": [1, 2], "y": [2, 1]}, 5)
    got = [r["lang_pred"] for r in language.identify(odd(spark), p).orderBy("doc_id").collect()]
    assert got[:3] == ["und"] * 3 and "und" not in got[3:]
    assert language.fit_profiles(none(spark).withColumn("lang", F.lit(None).cast("string"))).languages == [] and language.identify(none(spark), p).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd(spark), language.Profiles({}, 5)).collect()} == {"und"}


def test_ngrams_are_the_same_in_chunks(monkeypatch):
    text = "Ab cÉ, d! " * 200
    whole = language.ngrams(text)
    monkeypatch.setattr(language, "_CHUNK", 17)
    assert all((a == b).all() for a, b in zip(whole, language.ngrams(text), strict=True))


def small_index():
    rows = [(i, 1, int(i % 3 == 0), {0: 1 + i % 2} if i % 3 == 0 else {1: 1} if i % 3 == 1 else {}) for i in range(60)]
    rows += [(100 + i, 1, i % 2, {j: 1 + (i + j) % 3 for j in range(2, 9) if (i >> (j - 2)) & 1}) for i in range(1, 120)]
    return toxicity.build_index(rows, ["idiot", "nice", *"abcdefg"], np.linspace(1, 2, 9), k=7, block=5), rows


def brute_nearest(index, q):
    """Similarities and places of the nearest, of ties the first, by all products."""
    sims = np.round(q @ index.vectors.T, 9)
    order = np.argsort(-sims, axis=1, kind="stable")[:, : index.k]
    best = np.take_along_axis(sims, order, 1)
    return np.where(best > 1e-9, best, -1), np.where(best > 1e-9, order, -1)


def test_neighbours_are_exact():
    index, _ = small_index()
    rnd = np.random.default_rng(0)
    q = rnd.random((50, 9)) * (rnd.random((50, 9)) < 0.4)
    q = q[q.any(axis=1)]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    assert (index.common >= 0).any() and (index.common < 0).any()
    for got, want in zip(index.nearest(q), brute_nearest(index, q), strict=True):
        assert np.allclose(got[:, : want.shape[1]], want)


def test_votes_and_calibration_by_definition():
    """Weighted votes of the nearest others, and the curve that fits them best, computed one by one."""
    index, rows = small_index()
    v, n, toxic = index.vectors, index.n, index.toxic
    vote = lambda w, t, m: ((w * t).sum() + index.prior_weight * index.share) / ((w * m).sum() + index.prior_weight)
    x, y, weight = [], [], []
    for i in range(len(v)):
        for label, count in ((0, n[i] - toxic[i]), (1, toxic[i])):
            if count:
                sims = np.minimum(np.round(v @ v[i], 9), 1 - 2e-6)
                sims[i] = 1
                order = np.argsort(-sims, kind="stable")[: index.k]
                order = order[sims[order] > 1e-9]
                t, m = toxic[order].astype(float), n[order].astype(float)
                t[order == i] -= label
                m[order == i] -= 1
                x.append(vote(sims[order] ** index.sharpness, t, m))
                y.append(label)
                weight.append(count)
    for label in (0, 1):
        x.append(index.blank_vote())
        y.append(label)
        weight.append(index.blank[1] if label else index.blank[0] - index.blank[1])
    z = np.log(np.clip(x, 1e-4, 1 - 1e-4) / (1 - np.clip(x, 1e-4, 1 - 1e-4)))
    y, weight = np.array(y, float), np.array(weight, float)
    loss = lambda a, b: (weight * (np.logaddexp(0, a * z + b) - y * (a * z + b))).sum() + 5e-4 * ((a - 1) ** 2 + b**2)
    a, b = index.curve
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert sum(r[1] for r in rows) == index.n.sum() + index.blank[0]


def test_fit_counts_what_it_is_given(spark):
    """idf and association by definition; repeated labels are votes, of two texts under one id one counts, other columns do not matter."""
    rows = [(1, "bad words here"), (2, "good words there"), (3, "bad thing"), (4, None), (5, "unlabelled words"), (1, "bad words here too")]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], "doc_id long, text string, label string, n int, toxic string")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 0, "a"), (3, 1, "a"), (4, 0, "a"), (4, None, "a"), (None, 1, "a"), (99, 1, "a")], "doc_id long, toxic int, text string")
    index = toxicity.fit(docs, labels)
    first = min((rows[0][1], rows[5][1]), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    taught = {1: first, 2: rows[1][1], 3: rows[2][1], 4: ""}
    assert sorted(index.terms) == sorted({w for t in taught.values() for w in t.split()}) and index.blank == (1, 0)
    assert dict(zip(index.ids, zip(index.n, index.toxic, strict=True), strict=True)) == {1: (2, 2), 2: (1, 0), 3: (1, 1)}
    for term, idf in zip(index.terms, index.idf, strict=True):
        df = sum(term in (t or "").split() for _, t in rows)
        d = sum(term in t.split() for t in taught.values())
        bad = sum(term in t.split() for i, t in taught.items() if i in (1, 3))
        assert abs(idf - np.log(1 + len(rows) / df) * max(abs(bad - d / 2) / np.sqrt(d / 4 + 0.5), 0.01)) < 1e-9
    words = spark.createDataFrame([("p", "bad one"), ("q", "fine one")], "doc_id string, text string")
    named = toxicity.fit(words, spark.createDataFrame([("p", 1), ("q", 0)], "doc_id string, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(words, named).collect()}
    assert got["p"]["evidence"][0]["example"] == "p" and got["p"]["score"] > got["q"]["score"]


def test_the_driver_deals_no_index(spark):
    """Left-out votes come from tasks, equal to those taken here; what is dealt is made where neighbours are asked for."""
    docs = spark.createDataFrame([(i, f"{'idiot ' * (i % 3 == 0)}word{i % 40} and {'nice ' * (i % 5)} w{i}") for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(700)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert len(index.ids) > 512 and not {"heavy", "peaks", "post_at", "post_weight"} & set(index.__dict__)
    assert all((a == b).all() for a, b in zip(toxicity.left_out_votes(spark, index), index.left_out(np.arange(len(index.ids))), strict=True))
    curve = index.curve
    index.calibrate()
    assert index.curve == curve != (1.0, 0.0)


def test_samples_do_not_become_empty(spark):
    """At any size the share asked for is met by hashes of 63 bits."""
    from mediaprism.llm.common import sampled

    rows = spark.range(0, 2_000_000)
    for share in (1.0, 0.01, 1e-3):
        n = rows.where(sampled("id", "x", F.lit(share))).count()
        assert abs(n - share * 2e6) <= 5 * np.sqrt(share * 2e6) if share < 1 else n == 2_000_000
    # 8,000 of 10^11 rows: the bound still leaves 2^63 * 8e-8 hashes in.
    least = rows.select(F.min(F.shiftrightunsigned(F.xxhash64("id", F.lit("x")), 1)).alias("m")).first()["m"]
    assert rows.where(sampled("id", "x", F.lit(8_000 / 1e11))).count() == int(least < 8e-8 * 2**63)
    assert 8_000 / 1e11 * 2**63 > 1e11


def test_toxicity_scores(spark):
    index, _ = small_index()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(odd(spark), index).collect()}
    assert got[10]["predicted"] == 1 and got[10]["evidence"][0]["similarity"] == 1 and got[0]["score"] == got[1]["score"] < 0.5
    assert all(0 <= r["score"] <= 1 for r in got.values()) and toxicity.score_toxicity(none(spark), index).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(odd(spark), labels)
    assert {r["score"] for r in toxicity.score_toxicity(odd(spark), empty).collect()} == {0.0}


def test_workers_let_go_of_other_stages_tables():
    import gc
    import weakref

    from mediaprism.llm.common import make_room

    held = weakref.ref(tokenization.word_ids(WORDS))
    assert held() is tokenization.word_ids(WORDS)
    make_room()
    assert held() is None
    counts = weakref.ref(tokenization.byte_counts(BYTES))
    tokenization.word_ids(WORDS)
    gc.collect()
    assert counts() is None


def test_toxicity_index_is_dealt_in_little_more_than_it_holds():
    import tracemalloc

    r = np.random.default_rng(4)
    rows = [(i, 1, i % 2, {int(t): 1 for t in r.integers(0, 20_000, 300) ** 2 // 20_000}) for i in range(3000)]
    index = toxicity.build_index(rows, [str(t) for t in range(20_000)], r.random(20_000) + 0.1, calibrated=False)
    tracemalloc.start()
    index._deal()
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 1.2 * held


def test_frequent_words_have_no_postings():
    """Postings of strong words that many examples hold were most of the products a query took; the neighbours stay exact."""
    r = np.random.default_rng(5)
    chance = np.concatenate([np.full(20, 0.3), np.full(400, 0.01)])
    rows = [(i, 1, i % 2, {int(t): int(r.integers(1, 4)) for t in np.nonzero(r.random(420) < chance)[0]}) for i in range(1500)]
    index = toxicity.build_index(rows, [str(t) for t in range(420)], r.random(420) + 0.1, calibrated=False)
    assert np.diff(index.post_start).max() <= len(index.ids) // 26 and (index.common >= 0).sum() == 20
    q = index.vectors[::5] + index.vectors[::-5]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for got, want in zip(index.nearest(q), brute_nearest(index, q), strict=True):
        assert np.allclose(got, want)


def test_words_are_runs_of_letters_and_digits():
    every = [chr(i) for i in range(0x110000)]
    texts = ["".join(f"A{c}b{c} 1" for c in every[i : i + 4096]) for i in range(0, len(every), 4096)] + [None, "", "_ .", "İx_É9-ß"]
    want = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert [toxicity.word_list(t) for t in texts] == want
    where = {w: i for i, w in enumerate(sorted({w for found in want for w in found[::2]}))}
    sizes, numbers, times = toxicity.known_words(texts, where)
    got = [dict(zip(n.tolist(), m.tolist(), strict=True)) for n, m in zip(np.split(numbers, np.cumsum(sizes)[:-1]), np.split(times, np.cumsum(sizes)[:-1]), strict=True)]
    assert got == [{where[w]: n for w, n in Counter(found).items() if w in where} for found in want]
    assert [x.tolist() for x in toxicity.known_words(texts, {})] == [[0] * len(texts), [], []]


def test_workers_number_the_terms_once():
    import pickle

    from mediaprism.llm.common import make_room

    terms = toxicity.Numbered.of(["b", "a"])
    found = terms.where()
    assert found == {"b": 0, "a": 1} and pickle.loads(pickle.dumps(terms)).where() is found
    assert toxicity.Numbered.of(["b", "c"]).where() == {"b": 0, "c": 1} and terms.where() is not found
    make_room()


def test_toxicity_query(spark):
    out = queries.op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.85


def test_toxicity_sees_words_of_few_examples(spark):
    """Each toxic example has tail words of its own and they are many more than any chosen vocabulary would hold."""
    own = lambda i: f"tail{i}x tail{i}y"
    rows = [(i, f"the and of {own(i)} " + ("zorn" if i % 2 else "mild"), i % 2) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, own(i)) for i in (7, 8)] + [(2000, "nothing known here")], "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, index).collect()}
    assert [got[i]["evidence"][0]["example"] for i in (1007, 1008)] == [7, 8] and got[1007]["predicted"] == 1 and got[1008]["predicted"] == 0
    assert not got[2000]["evidence"] and len(index.terms) == 1205
    # Both kinds of words, those with postings and the others, against all pairs.
    v = index.vectors[::7] + 0.5 * index.vectors[::-7][: len(index.vectors[::7])]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert (index.common >= 0).any() and (index.common < 0).any()
    for got, want in zip(index.nearest(v), brute_nearest(index, v), strict=True):
        assert np.allclose(got, want)


# --- 6: decontamination


def brute_hits(docs, items):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in windows:
                    found |= windows[k]
                    hit.update(range(s, s + size))
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_bytes": 1000}])
def test_decontamination(spark, limits):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "The"), (901, "that it"), (902, None), (903, "..."), (905, "That it"), (906, "a b c d e"), (906, "a b c d e"), (907, "la " * 40)]
    docs = texts_of(spark) + [(-1, None), (-1, None), (-2, ""), (-3, "that IT."), (-3, "that IT."), (-4, "x a b c d e y"), (-5, "la " * 300), (-6, items[0][1] + " and " + items[1][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "item": F.lit(2)}), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.decontamination_report(d, i, **limits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_hits(docs, items), key=str)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_an_item_without_an_id_hits(spark, broadcast_rows):
    long = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(None, long), (None, "a b c"), (3, "d e f")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, "a b c"), (3, "x d e f"), (4, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.decontamination_report(docs, items, broadcast_rows=broadcast_rows).collect()}
    assert got == {1: (20, 0, True), 2: (3, 0, True), 3: (3, 1, True), 4: (0, 0, False)}


def test_clean_documents_do_not_travel(spark):
    """On the shuffle path no words are brought to documents that met nothing: their texts are dropped by a semi-join before they are split."""
    docs = spark.createDataFrame([(i, f"clean text number {i} " + "of no item " * 9) for i in range(50)] + [(99, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 25)))], "item_id long, text string")
    hits = decontamination.find_hits(docs, items, broadcast_rows=0)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and str(decontamination._EVERY) not in plan
    got = {r["doc_id"]: r["spans"] for r in hits.collect()}
    assert len(got) == 51 and {p for s in got[99] for p in range(s["start"], s["start"] + s["length"])} == set(range(5, 25)) and not any(got[i] for i in range(50))


def test_decontamination_without_rows(spark):
    d, i = odd(spark), spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontamination.decontamination_report(d, i).collect()} == {False}
    assert decontamination.decontamination_report(d, i, broadcast_rows=-1).count() == len(ODD) + 1
    assert decontamination.decontamination_report(none(spark), i).count() == 0


# --- 7: SimHash


def brute_simhash(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_bits():
    for t in [*ODD, "one two three", "A b C d E f A b C d"]:
        assert simhash.simhash(t) == brute_simhash(t)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_near_links_connect_what_brute_force_connects(spark, bucket_rows):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)} | {0}
    for f in list(fps)[:12]:
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    linked = {r["node"]: r["component"] for r in components(simhash.near_links(rows, radius=4, bucket_rows=bucket_rows)).collect()}
    want = union([(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 4], signed)
    assert {f: linked.get(f, f) for f in signed} == want


def test_thresholds_keep_the_pigeonhole():
    rnd = np.random.default_rng(1)
    for n in (10, 10**5, 10**7, 10**9):
        parts = simhash.allocate(rnd.integers(0, 2**63, 500).astype(np.uint64), n, 4)
        assert sum(t + 1 for _, t in parts) == 5 and len({b for g, _ in parts for b in g}) == sum(len(g) for g, _ in parts)


def test_near_duplicates(spark):
    rows = texts_of(spark) + [(1000, None), (1001, ""), (1002, "  "), (1003, "x"), (1003, "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))).collect()
    fps = {i: brute_simhash(t) for i, t in rows}
    want = union([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((i, fps[i], want[i]) for i, _ in rows)
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_equal_ids_with_different_texts_are_documents_of_their_own(spark):
    rows = [(1, "one two three four five six"), (1, "quite another text of seven words here"), (2, "one two three four five six"), (None, "a text without any id at all"), (None, "a text without any id at all"), (3, "A text without any id at all"), (None, "its own text and no id"), (3, "A text without any id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "group": F.lit("g"), "key": F.lit(0)})
    got = sorted((r["doc_id"] or 0, r["fp"] % (1 << 64), r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i or 0, brute_simhash(t), {rows[0][1]: 1, rows[1][1]: 1, rows[6][1]: 0}.get(t, 3)) for i, t in rows)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, rows[0][1]), (1, rows[1][1]), (3, rows[5][1]), (0, rows[6][1])])
    assert simhash.one_of_each_group(none(spark)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 99)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {i: 0 for i in range(41)} | {99: 99, 100: 99}


# --- 8: chat


def test_chat_folds_events(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "Wo"), (1, 2, "delta", 1, None, "rd <|im_end|>\n"), (1, 3, "message", 2, "user", "no"), (1, 4, "edit", 2, None, "yes & <|"), (1, 5, "message", 3, "assistant", "bad"), (1, 6, "regenerate", 3, None, None), (1, 7, "delta", 3, None, "go"), (1, 8, "delta", 3, None, "od"), (2, 0, "delta", 9, "tool\nx", "lone")]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id long, role string, text string").withColumn("nth", F.lit(5))
    made = chat.render(chat.fold_log(events))
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hi"), ("assistant", "Word <|im_end|>\n"), ("user", "yes & <|"), ("assistant", "good")]
    assert back[1]["learnt"] == "Word <|im_end|>\ngood" and back[2]["learnt"] == ""
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("tool\nx", "lone")]
    row = made.where("conv_id = 1").first()
    said = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
    assert said == ["Word &lt;|im_end|>\n", "good"] and row["formatted"].count("<|im_end|>") == 4
    assert chat.fold_log(events.limit(0)).count() == 0


def test_a_wrong_mask_shows(spark):
    """The loss text is read from the output by the mask's numbers alone."""
    turns = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "an & answer"), (1, 2, "user", None), (1, 3, "assistant", "🙂 <|x"), (1, 3, "assistant", "🙂 <|x")], "conv_id long, turn long, role string, text string")
    made = chat.render(chat.fold_log(chat.turns_as_stream(turns)))
    assert chat.read_back(made).first()["learnt"] == "an & answer🙂 <|x🙂 <|x"
    off = made.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), (s["length"] - 1).alias("length"))))
    assert chat.read_back(off).first()["learnt"] == "n & answer <|x <|x"
    assert [(t["role"], t["text"]) for t in chat.read_back(off).first()["turns"]] == [("user", "ask"), ("assistant", "an & answer"), ("user", ""), ("assistant", "🙂 <|x"), ("assistant", "🙂 <|x")]
    plan = queries.op8_chat(spark, SF)._jdf.queryExecution().toString()
    assert "RDD" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(queries.SQL[name]).df())


# --- 9: media


def test_media_round_trip(spark):
    rows = texts_of(spark)[:40] + list(enumerate(ODD, 1000))
    got = {r["id"]: r for r in media_columns.sniff_media(media_columns.text_to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r, stored = got[i], media_columns.store_as_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["media_sha256"], r["tail_crc32"], r["detected"], r["corrected"]) == (hashlib.sha256(stored).hexdigest(), zlib.crc32(payload[-64:]), "audio/wav", True)
        assert wave.open(io.BytesIO(stored)).readframes(1 << 30) == payload
    assert media_columns.sniff_media(media_columns.text_to_media(none(spark))).count() == 0


def png():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0\0")) + part(b"IEND", b"")


def test_sniffing_confirms_and_carves():
    import gzip

    p, gif = png(), b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    assert media_columns.sniff(p) == [("image/png", 0, len(p))] and media_columns.sniff(gif) == [("image/gif", 0, len(gif))]
    assert media_columns.sniff(p[:-3]) == [] and media_columns.sniff(b"GIF89a is a magic") == [] and media_columns.sniff(None) == []
    z = gzip.compress(b"x" * 100)
    held = media_columns.store_as_wav(media_columns.padded(b"text " + p + b" RIFF fLaC " + gif + z))
    assert media_columns.sniff(held) == [("audio/wav", 0, len(held)), ("image/png", 49, len(p)), ("image/gif", 60 + len(p), len(gif)), ("application/gzip", 60 + len(p) + len(gif), len(z))]


def flac(frames=3, samples=192):
    """Frames of one value each, which need no decoder to write."""

    def crc(data, polynomial, bits):
        r = 0
        for b in data:
            r ^= b << bits - 8
            for _ in range(8):
                r = (r << 1 ^ polynomial if r >> bits - 1 else r << 1) & (1 << bits) - 1
        return r

    out = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 192, 192) + bytes(6) + struct.pack(">Q", 44100 << 44 | 7 << 36 | frames * samples) + bytes(16)
    for i in range(frames):
        head = bytes([0xFF, 0xF8, 0x19, 0x00, i])
        body = head + bytes([crc(head, 7, 8)]) + bytes([0x00, 0x12, 0x00 | i])  # constant subframe
        out += body + struct.pack(">H", crc(body, 0x8005, 16))
    return out


def test_what_follows_audio_is_carved():
    p = png()
    mp3 = b"ID3\x03\0\0\0\0\0\x05extra" + (b"\xff\xfb\x90\x00" + bytes(413)) * 3
    for kind, audio in (("audio/flac", flac()), ("audio/mpeg", mp3)):
        data = b"..." + audio + b"between" + p + b"tail"
        assert media_columns.sniff(data) == [(kind, 3, len(audio)), ("image/png", 10 + len(audio), len(p))]
        assert media_columns.sniff(audio) == [(kind, 0, len(audio))]
    assert media_columns.sniff(flac()[:-1]) == [] and media_columns.sniff(mp3[:200]) == []


def test_documents_and_archives_are_carved():
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "text")
        z.writestr("b.txt", "more")
    archive, pdf = held.getvalue(), b"%PDF-1.4 body startxref 5 %%EOF"
    assert media_columns.sniff(b"x" + archive + b"y" + pdf + b"z" + archive) == [("application/zip", 1, len(archive)), ("application/pdf", 2 + len(archive), len(pdf)), ("application/zip", 3 + len(archive) + len(pdf), len(archive))]
    assert media_columns.sniff(b"%PDF-1 without an end") == [] and media_columns.sniff(b"PK\x03\x04 no directory PK\x05\x06") == []


@pytest.mark.parametrize("part", [b"%PDF-1 ", b"PK\x03\x04...", b"GIF89a!!!!!!!!", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"\xff\xd8\xff\xe0\0\x04..", b"OggS\0\0.......................", b"ID3\x03\0\0\0\0\0\0", b"....ftyp"])
def test_many_magics_take_linear_time(part):
    import time

    took = []
    for size in (1 << 20, 1 << 22):
        data = part * (size // len(part))
        began = time.perf_counter()
        media_columns.sniff(data)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 1


def test_media_with_clashing_columns(spark):
    docs = odd(spark).withColumns({c: F.lit("x") for c in ("media", "declared", "n_bytes", "payload_sha256")})
    got = media_columns.sniff_media(media_columns.text_to_media(docs)).collect()
    assert len(got) == len(ODD) + 1 and all(r["detected"] == "audio/wav" for r in got)
    kept = spark.createDataFrame([("k", bytearray(png()), "image/gif", 1)], "id string, blob binary, claims string, detected int")
    row = media_columns.sniff_media(kept, media_col="blob", declared_col="claims", keep=("id",)).first()
    assert (row["detected"], row["corrected"], row["declared"]) == ("image/png", True, "image/gif")


# --- 10: line dedup


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(2)
    lines = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(1, 12))) for _ in range(25)]
    rows = [(i, rnd.choice(["\n", ". "]).join(rnd.choice(lines) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    passage = "\n".join(f"passage line {i} of some ten words that is here again" for i in range(6))
    rows += [(100, f"own start\n{passage}\nown end"), (101, f"other\n{passage}\nlast"), (102, passage), (103, None), (104, ""), (101, f"other\n{passage}\nlast"), (105, "la la la\n" * 40), (106, passage.split("\n")[0])]
    rows += [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(10, 90)))) for i in range(200, 230)]  # long sentences
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"version": F.lit("x"), "gone": F.lit(1), "row": F.lit(2), "key": F.lit("k")})
    got = {(r["id"]): r["gone"] for r in line_dedup.repeated_lines(docs).collect()}
    want = {k[0]: v for k, v in line_dedup.brute_force(rows).items()}
    assert got == want and got[101] == list(range(1, 7)) and got[100] == [] and got[106] == []
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out[101] == "other\nlast" and out[100] == rows[60][1] and 102 not in out and out[103] is None and out[104] == ""
    assert line_dedup.repeated_lines(none(spark)).count() == 0


def test_passages_inside_long_lines_are_found(spark):
    """A passage of 51 words with other words before and after it in the same line, without a sentence end near."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    passage = " ".join(word() for _ in range(51))
    own = lambda: " ".join(word() for _ in range(rnd.randint(3, 40)))
    rows = [(i, f"{own()} {passage} {own()}") for i in range(12)] + [(50, " | ".join(word() for _ in range(60))), (51, own() + "! " + own() + "? ")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = set(passage.split())
    assert out[0] == rows[0][1] and out[50] == rows[12][1] and out[51] == rows[13][1]
    for i in range(1, 12):
        head, tail = rows[i][1].split(passage)
        assert out[i].startswith(head) and out[i].endswith(tail) and sum(w in kept for w in out[i].split()) <= 51 - 25


def test_line_dedup_of_equal_ids_and_no_ids(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (None, passage), (1, "x " + passage), (1, "another text under the same id"), (1, "x " + passage)]
    out = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [t for i, t in out if i == 0] == [passage] * 2 and out[2] == (1, "another text under the same id") and all(len(t.split()) < 20 for i, t in out if i)


def test_lines_join_again():
    for t in ["a. b. c\n\nd. ", "x\ny\n", ". . .", " lead. two  words . \n\n  x", "w " * 200]:
        assert line_dedup.without_lines(t, set()) == t
    assert line_dedup.without_lines("a. b. c.\nd", {1}) == "a. c.\nd" and line_dedup.without_lines("a. b.\nd", {1}) == "a.\nd"


def test_a_very_long_text_of_one_line(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, "own " + long)], "doc_id long, text string")).collect()}
    assert out[1] == long and len(out[2].split()) < 20
