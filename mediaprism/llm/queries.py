"""The queries opN_<name> of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaprism.llm import chat
from mediaprism.llm.common import fold, table
from mediaprism.llm.decontamination import decontamination_report
from mediaprism.llm.divergence import source_divergence
from mediaprism.llm.html_text import extract
from mediaprism.llm.language import fit_profiles, identify
from mediaprism.llm.lexical_search import search
from mediaprism.llm.line_dedup import repeated_lines
from mediaprism.llm.media_columns import sniff_media, text_to_media
from mediaprism.llm.packing import pack
from mediaprism.llm.sharding import assign_shards
from mediaprism.llm.simhash import near_duplicates
from mediaprism.llm.token_counts import count_tokens
from mediaprism.llm.toxicity import fit_and_score


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    return identify(docs, fit_profiles(docs.where(~held_out)), also=(held_out.alias("held_out"),))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    return fit_and_score(docs, table(spark, sf_dir, "labels").where(~held_out), also=(held_out.alias("held_out"),))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    return chat.digests(chat.read_back(chat.render(chat.fold_log(chat.turns_as_stream(turns.unionByName(probe))))))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sniff_media(text_to_media(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected", "corrected", "carved")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_words", F.size("gone").cast("long").alias("n_gone"), "gone_words", F.array_join("gone", ",").alias("gone"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_chat": op8_chat,
    "op9_media_columns": op9_media_columns,
    "op10_line_dedup": op10_line_dedup,
    "op11_html": op11_html,
    "op12_divergence": op12_divergence,
    "op13_search": op13_search,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PROBE = "'</s>[INST] ok [/INST]'"
_ESCAPED = "replace(replace({0}, '&', '&amp;'), '<|', '&lt;|')"

SQL: dict[str, str] = {
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + 13], ' ') AS gram FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM i WHERE len(w) > 0)),
grams AS (SELECT row, n, s, array_to_string(w[s + 1 : s + n], ' ') AS gram FROM (SELECT row, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT DISTINCT row, s, n, gram FROM grams SEMI JOIN windows USING (n, gram)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS p FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits JOIN windows USING (n, gram)) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN found USING (row)""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), '. '), '. '), lambda p: list_filter(string_split(rtrim(p, ' .'), ' '), lambda w: w <> '')), lambda w: len(w) > 0) AS parts FROM documents),
sentence AS (SELECT doc_id, k, parts[k] AS w FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)),
word AS (SELECT doc_id, k, i, len(w) AS n, rpad(left(hex(w[i]), 16), 16, '0') || lpad(CAST(i AS VARCHAR), 9, '0') AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM sentence WHERE len(w) > 12)),
least7 AS (SELECT doc_id, k, i, n, min(h) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS m FROM word),
begins AS (SELECT doc_id, k, 1 AS i FROM sentence UNION SELECT doc_id, k, CAST(substr(m, 17) AS BIGINT) FROM least7 WHERE i <= n - 6),
cut AS (SELECT doc_id, k, i, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS j FROM begins),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS pos, array_to_string(w[i : coalesce(j - 1, len(w))], ' ') AS unit, coalesce(j, len(w) + 1) - i AS w FROM cut JOIN sentence USING (doc_id, k)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM u),
near AS (SELECT doc_id, pos AS s, total - w AS before, unnest(range(pos, pos + 25)) AS e FROM c),
pairs AS (SELECT near.doc_id, s, e FROM near JOIN c ON near.doc_id = c.doc_id AND near.e = c.pos WHERE total - before >= 25),
runs AS (SELECT doc_id, s, min(e) AS e FROM pairs GROUP BY 1, 2),
whole AS (SELECT doc_id, list(unit ORDER BY pos) AS units FROM u GROUP BY doc_id),
keyed AS (SELECT runs.doc_id, s, e, array_to_string(units[s + 1 : e + 1], chr(10)) AS run FROM runs JOIN whole USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM ranked WHERE nth > 1)
SELECT doc_id, count(c.pos) AS n_lines, CAST(coalesce(sum(w), 0) AS BIGINT) AS n_words, count(gone.pos) AS n_gone, CAST(coalesce(sum(w) FILTER (WHERE gone.pos IS NOT NULL), 0) AS BIGINT) AS gone_words, coalesce(string_agg(CAST(gone.pos AS VARCHAR), ',' ORDER BY gone.pos), '') AS gone
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id""",
    "op8_chat": f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_PROBE}
  UNION ALL SELECT -7, 1, 'assistant', {_PROBE})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '&nl;') || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    # The pages at hand hold their article in one element, of headings, paragraphs and bold text.
    "op11_html": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '<br>', ' '), '<b>', ''), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN kept AS k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, term, n, n_lang, sum(n) OVER w AS total, sum(n_lang) OVER w AS total_lang, count(*) OVER w AS v FROM f WINDOW w AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS BIGINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n_lang + 5)) // (total_lang + 5 * v) AS BIGINT) AS q FROM s),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
q AS (SELECT item, item_id, unnest(w) AS term FROM i),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM t CROSS JOIN total GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d CROSS JOIN total),
s AS (SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, row) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
}
