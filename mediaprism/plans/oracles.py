"""The checks once more, as plain SQL over the same relations, to hold the DataFrame forms against."""

from __future__ import annotations

from mediaprism.options import AVC_TIERS
from mediaprism.plans.relations import oracle

_R = "'r' || rendition"
_P = "'r' || rendition || '/' || sequence"
_S = "'s' || stream || '/'"
_NONE = "CAST(NULL AS DOUBLE)"


def _rows(check: str, *parts: tuple[str, str, str, str, str]) -> str:
    """Each part: rule, target, status, value (SQL expressions; rule and status may be names) and what follows FROM."""
    word = lambda x: f"'{x}'" if x.replace("-", "").isalnum() and not x.startswith("CASE") and x not in ("rule", "status") else x
    return "\nUNION ALL ".join(f"SELECT '{check}' AS \"check\", {word(rule)} AS rule, {target} AS target, {word(status)} AS status, CAST({value} AS DOUBLE) AS value FROM {source}" for rule, target, status, value, source in parts)


def _with(ctes: str, body: str) -> str:
    return oracle(f", {ctes}\n{body}")


_PAIR = """w AS (SELECT *, lag(sequence) OVER o AS ls, lag(min_pts) OVER o AS lp, lag(timescale) OVER o AS lt, lag(measured_us) OVER o AS lm,
    lag(codec) OVER o AS lc, lag(width) OVER o AS lw, lag(height) OVER o AS lh, lag(pdt_us) OVER o AS lclock
  FROM {src} WINDOW o AS (PARTITION BY rendition ORDER BY sequence)),
pair AS (SELECT *, (CASE WHEN min_pts - lp > 4294967296 THEN min_pts - lp - 8589934592 WHEN min_pts - lp < -4294967296 THEN min_pts - lp + 8589934592 ELSE min_pts - lp END) * 1000000 - lm * timescale AS drift,
  ls = sequence - 1 AS adjacent FROM w)"""


def _case(*when: tuple[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in when) + f" ELSE '{other}' END"


_RATES = """m AS (SELECT p.*, r.bandwidth, CAST(bytes * 8000000 AS DOUBLE) / measured_us AS bps FROM p JOIN r USING (rendition) WHERE measured_us > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY rendition ORDER BY bps DESC, sequence) AS rk FROM m),
rates AS (SELECT rendition, max(kind) AS kind, max(bandwidth) AS bandwidth, max(bps) AS peak, max(CASE WHEN rk = 1 THEN sequence END) AS sequence, CAST(sum(bytes) * 8000000 AS DOUBLE) / sum(measured_us) AS av FROM k GROUP BY rendition)"""

_RI = "(SELECT * FROM r WHERE NOT init_failed)"

SQL: dict[str, str] = {}

SQL["manifest"] = oracle(_rows("manifest", (_case(("failed", "unreachable"), ("bandwidth <= 0", "unusable"), other="shape"), _R, _case(("failed", "ERROR"), ("bandwidth <= 0", "BAD"), other="OK"), "(SELECT count(*) FROM s0 WHERE s0.rendition = r0.rendition)", "r0")))

SQL["fetch"] = oracle(_rows(
    "fetch",
    ("rendition", _R, "ERROR", "NULL", "r0 WHERE failed"),
    ("empty", _R, "BAD", "NULL", "r WHERE rendition NOT IN (SELECT rendition FROM s)"),
    ("segment", _P, "ERROR", "NULL", "s WHERE NOT fetched"),
    ("truncated", _P, "WARN", "bytes", "s WHERE fetched AND truncated"),
    ("fetched", _R, "OK", "count(*)", "s WHERE fetched GROUP BY rendition"),
))

SQL["init"] = oracle(_rows("init", ("unfetched", _R, "ERROR", "NULL", "r WHERE init_failed")))

SQL["container"] = oracle(_rows(
    "container",
    ("unparseable", _P, "BAD", "bytes", "s WHERE fetched AND NOT parsed AND supported"),
    ("unsupported", _R, "OK", "count(*)", "s WHERE fetched AND NOT parsed AND NOT supported GROUP BY rendition"),
    ("opaque", _R, "OK", "count(*)", "p WHERE opaque GROUP BY rendition"),
    (_case(("count(DISTINCT container) > 1", "mixed"), other="uniform"), _R, _case(("count(DISTINCT container) > 1", "WARN"), other="OK"), "count(DISTINCT container)", "p GROUP BY rendition"),
))

SQL["bitrate"] = _with(_RATES + ", j AS (SELECT *, peak * 100 > bandwidth * 110 AS hi, av * 2 < bandwidth AS lo FROM rates WHERE bandwidth > 0)", _rows("bitrate", (_case(("hi", "peak"), ("lo", "overdeclared"), other="within"), f"CASE WHEN hi THEN {_P} ELSE {_R} END", _case(("hi OR lo", "WARN"), other="OK"), "CASE WHEN hi THEN peak ELSE av END", "j")))

SQL["resolution"] = _with(
    f"j AS (SELECT p.rendition, min(CASE WHEN p.width <> q.width OR p.height <> q.height THEN sequence END) AS sequence, count(*) AS n FROM p JOIN {_RI} q USING (rendition) WHERE p.kind = 'video' AND p.width IS NOT NULL AND q.width IS NOT NULL GROUP BY 1)",
    _rows("resolution", (_case(("sequence IS NULL", "agrees"), other="differs"), f"CASE WHEN sequence IS NULL THEN {_R} ELSE {_P} END", _case(("sequence IS NULL", "OK"), other="BAD"), "n", "j")),
)

SQL["tracks"] = _with(
    f"""f AS (SELECT p.*, CASE WHEN p.kind = 'video' AND codecs LIKE 'avc1%' THEN 'h264' WHEN p.kind = 'video' AND (codecs LIKE 'hvc1%' OR codecs LIKE 'hev1%') THEN 'hevc' WHEN p.kind = 'video' AND codecs LIKE 'av01%' THEN 'av1' WHEN p.kind = 'audio' AND codecs LIKE 'mp4a%' THEN 'aac' END AS family FROM p JOIN {_RI} q USING (rendition) WHERE p.kind IN ('video', 'audio')),
g AS (SELECT rendition, kind, family, count(*) AS n, count(*) FILTER (WHERE video_tracks = 0) AS blind, count(DISTINCT video_tracks * 10 + audio_tracks) AS layouts, arg_min(codec, sequence) AS codec FROM f GROUP BY ALL)""",
    _rows(
        "tracks",
        (_case(("blind = n", "no-video"), other="video-missing"), _R, _case(("blind = n AND family IS NOT NULL", "BAD"), ("blind = n", "OK"), other="WARN"), "blind", "g WHERE kind = 'video' AND blind > 0"),
        ("layout", _R, "WARN", "layouts", "g WHERE layouts > 1"),
        ("codec", _R, "WARN", "NULL", "g WHERE codec <> family"),
        ("consistent", _R, "OK", "n", "g WHERE layouts = 1 AND (family IS NULL OR codec = family) AND (kind <> 'video' OR blind = 0)"),
    ),
)

SQL["keyframe"] = _with(
    f"k AS (SELECT *, opens_keyframe IS NOT NULL AND NOT opaque AS rd FROM p WHERE kind IN ('video', 'iframe') AND rendition IN (SELECT rendition FROM {_RI})), g AS (SELECT rendition, count(*) FILTER (WHERE rd) AS n, count(*) FILTER (WHERE rd AND NOT has_keyframe) AS zero, count(*) FILTER (WHERE rd AND NOT opens_keyframe) AS late FROM k GROUP BY 1)",
    _rows("keyframe", (_case(("n = 0", "unverified"), ("zero > 0", "none"), ("late > 0", "late"), other="opens"), _R, _case(("zero > 0", "BAD"), other="OK"), "CASE WHEN n = 0 THEN 0 WHEN zero > 0 THEN zero WHEN late > 0 THEN late ELSE n END", "g")),
)

SQL["framerate"] = _with(
    f"""f AS (SELECT p.stream, p.rendition, p.kind, fps_milli, CAST(floor(CAST(timescale * 1000 AS DOUBLE) / frame_dur) AS BIGINT) AS fps, row_number() OVER (PARTITION BY p.rendition ORDER BY floor(CAST(timescale * 1000 AS DOUBLE) / frame_dur)) AS k, count(*) OVER (PARTITION BY p.rendition) AS n
  FROM p JOIN {_RI} q USING (rendition) WHERE p.kind <> 'audio' AND frame_dur > 0),
g AS (SELECT * FROM f WHERE k = n // 2 + 1), v AS (SELECT stream, fps, max(fps) OVER (PARTITION BY stream) / CAST(fps AS DOUBLE) AS ratio, count(*) OVER (PARTITION BY stream) AS rungs FROM g WHERE kind = 'video'),
odd AS (SELECT stream, count(*) AS n FROM v WHERE rungs > 1 AND abs(ratio - greatest(floor(ratio + 0.5), 1)) * 100 > greatest(floor(ratio + 0.5), 1) * 2 GROUP BY stream)""",
    _rows(
        "framerate",
        (_case(("fps_milli IS NULL", "undeclared"), ("abs(fps - fps_milli) * 100 > fps_milli * 2", "differs"), other="agrees"), _R, _case(("abs(fps - fps_milli) * 100 > fps_milli * 2", "WARN"), other="OK"), "fps / 1000", "g"),
        ("ladder", f"{_S} || 'ladder'", "WARN", "n", "odd"),
    ),
)

SQL["audio"] = _with(
    f"""g AS (SELECT p.rendition, q.sample_rate AS sr, q.channels AS ch, codecs, count(DISTINCT coalesce(p.sample_rate, -1) || ',' || coalesce(p.channels, -1) || ',' || coalesce(codec, '-')) AS shapes, arg_min(p.sample_rate, sequence) AS f, arg_min(p.channels, sequence) AS c, arg_min(p.codec, sequence) AS k, arg_min(p.sbr, sequence) AS sbr
  FROM p JOIN {_RI} q USING (rendition) WHERE p.kind = 'audio' AND (p.sample_rate IS NOT NULL OR p.channels IS NOT NULL) GROUP BY ALL),
j AS (SELECT *, coalesce(sr <> f AND NOT (sbr AND f * 2 = sr), FALSE) AS a, coalesce(ch <> c, FALSE) AS b FROM g)""",
    _rows("audio", (_case(("shapes > 1", "varies"), ("a AND b", "rate+channels"), ("a", "rate"), ("b", "channels"), other="agrees"), _R, _case(("shapes > 1 OR a OR b", "BAD"), other="OK"), "shapes", "j")),
)

SQL["captions"] = _with(
    f"""f AS (SELECT p.rendition, captions, captions_none, captions_scanned AND NOT opaque AS sc, captions_seen FROM p JOIN {_RI} q USING (rendition) WHERE p.kind = 'video'),
e AS (SELECT DISTINCT rendition, c FROM (SELECT rendition, unnest(captions_seen) AS c FROM f WHERE sc)),
g AS (SELECT rendition, captions, captions_none, count(*) FILTER (WHERE sc) AS n, (SELECT count(*) FROM e WHERE e.rendition = f.rendition) AS kinds FROM f GROUP BY 1, 2, 3),
w AS (SELECT rendition, unnest(captions) AS c FROM g),
gone AS (SELECT rendition, count(*) AS gone FROM w WHERE regexp_matches(c, '^(CC[1-4]|SERVICE[0-9]+)$') AND NOT EXISTS (FROM e WHERE e.rendition = w.rendition AND (e.c = w.c OR e.c LIKE 'CC%' AND w.c LIKE 'CC%' AND substr(e.c, 3)::INT % 2 = substr(w.c, 3)::INT % 2 OR e.c = 'c608' AND w.c LIKE 'CC%' OR e.c = 'c708' AND w.c LIKE 'SERVICE%')) GROUP BY 1),
j AS (SELECT g.*, coalesce(gone, 0) AS gone, {_case(("len(captions) > 0 AND n = 0", "unscanned"), ("gone > 0", "missing"), ("captions_none AND kinds > 0", "unexpected"), other="agrees")} AS rule FROM g LEFT JOIN gone USING (rendition))""",
    _rows("captions", ("rule", _R, _case(("rule = 'unscanned'", "ERROR"), ("rule = 'missing'", "BAD"), ("rule = 'unexpected'", "WARN"), other="OK"), "CASE WHEN rule = 'missing' THEN gone ELSE kinds END", "j")),
)

SQL["encryption"] = _with(
    """g AS (SELECT rendition, count(*) AS n, count(*) FILTER (WHERE key_declared) AS said, count(*) FILTER (WHERE decrypted) AS op, count(*) FILTER (WHERE decrypt_failed) AS bad, count(*) FILTER (WHERE encrypted) AS seen FROM s WHERE fetched GROUP BY 1)""",
    _rows(
        "encryption",
        ("undecrypted", _R, "ERROR", "bad", "g WHERE bad > 0"),
        ("decrypted", _R, "OK", "op", "g WHERE bad = 0 AND op > 0"),
        ("undeclared", _R, "BAD", "seen", "g WHERE bad = 0 AND op = 0 AND said = 0 AND seen > 0"),
        ("partial", _R, "WARN", "said", "g WHERE bad = 0 AND op = 0 AND said > 0 AND said < n"),
        ("declared", _R, "OK", "said", "g WHERE bad = 0 AND op = 0 AND said > 0 AND said >= n"),
    ),
)

SQL["ladder"] = _with(
    "v AS (SELECT *, lag(height) OVER (PARTITION BY stream, period ORDER BY bandwidth, rendition) AS below FROM r WHERE kind = 'video')",
    _rows(
        "ladder",
        ("no-video", f"{_S} || 'ladder'", "BAD", "NULL", "(SELECT DISTINCT stream FROM r WHERE stream NOT IN (SELECT stream FROM v))"),
        ("duplicate", f"{_S} || 'p' || period || ':' || width || 'x' || height || '@' || bandwidth", "WARN", "count(*)", "v WHERE width > 0 AND height > 0 AND bandwidth > 0 GROUP BY stream, period, width, height, bandwidth HAVING count(*) > 1"),
        ("inverted", _R, "WARN", "below - height", "v WHERE height < below"),
        ("audio-group", _R, "BAD", "NULL", "v WHERE audio_group IS NOT NULL AND (stream, audio_group) NOT IN (SELECT (stream, group_id) FROM r WHERE kind = 'audio' AND group_id IS NOT NULL)"),
        ("no-codecs", _R, "WARN", "NULL", "v WHERE codecs = ''"),
    ),
)

SQL["pop"] = _with(
    "g AS (SELECT s.stream, edge, count(*) AS n, count(*) FILTER (WHERE missing) AS gone, count(*) FILTER (WHERE NOT missing AND s.digest <> e.digest) AS other FROM s JOIN edges e USING (rendition, sequence) WHERE fetched GROUP BY 1, 2)",
    _rows("pop", ("unreachable", f"{_S} || edge", "ERROR", "NULL", "g WHERE gone = n"), ("missing", f"{_S} || edge", "BAD", "gone", "g WHERE gone > 0 AND gone < n"), ("differs", f"{_S} || edge", "BAD", "other", "g WHERE other > 0"), ("agrees", f"{_S} || 'edges'", "OK", "max(n)", "g GROUP BY stream HAVING sum(gone + other) = 0")),
)

SQL["cache"] = _with(
    "g AS (SELECT s.rendition, live, count(*) FILTER (WHERE uncacheable) AS un, count(cache_status) AS known, count(*) FILTER (WHERE cache_status = 'MISS') AS miss FROM s JOIN r USING (rendition) WHERE fetched GROUP BY 1, 2)",
    _rows(
        "cache",
        ("uncacheable", _R, "BAD", "un", "g WHERE un > 0"),
        (_case(("known = 0", "silent"), ("miss = known", "all-miss"), other="hits"), _R, _case(("known > 0 AND miss = known AND live", "BAD"), ("known > 0 AND miss = known", "WARN"), other="OK"), "CASE WHEN known > 0 THEN (known - miss) * 100 / CAST(known AS DOUBLE) ELSE 0 END", "g"),
    ),
)

SQL["byterange"] = _with(
    "g AS (SELECT stream, host, bool_or(ranged) AS needed, bool_or(accepts_ranges) AS adv FROM s WHERE fetched GROUP BY 1, 2), j AS (SELECT *, coalesce(status = 206 AND got_bytes = asked_bytes, FALSE) AS exact FROM g JOIN probes USING (host))",
    _rows("byterange", (_case(("failed", "probe-failed"), ("exact", "partial"), ("needed", "needed"), ("adv", "advertised"), other="unused"), f"{_S} || host", _case(("failed", "ERROR"), ("exact", "OK"), ("needed", "BAD"), ("adv", "WARN"), other="OK"), "got_bytes", "j")),
)

SQL["codecstring"] = _with(
    """said(c, dp, dl, dt) AS (VALUES ('avc1.64001f', 100, 31, NULL), ('avc1.66.30', 66, 30, NULL), ('hev1.A2.4.L93.B0', 2, 93, 0), ('hvc1.2.4.H93.B0', 2, 93, 1), ('av01.0.08M.08', 0, 8, 0)),
v AS (SELECT p.rendition, any_value(split_part(codecs, ',', 1)) AS c, arg_min(profile_idc, sequence) AS pi, arg_min(level_idc, sequence) AS li, arg_min(tier, sequence) AS ti FROM p JOIN r USING (rendition) WHERE p.kind = 'video' AND profile_idc IS NOT NULL AND codecs <> '' GROUP BY 1),
w AS (SELECT * FROM v LEFT JOIN said USING (c)),
a AS (SELECT p.rendition, max(CASE WHEN codecs LIKE 'mp4a.40.%' THEN CAST(substr(codecs, 9) AS INT) END) AS ot, arg_min(object_type, sequence) FILTER (WHERE object_type IS NOT NULL) AS got, coalesce(arg_min(sbr, sequence) FILTER (WHERE object_type IS NOT NULL), arg_min(sbr, sequence)) AS rep FROM p JOIN r USING (rendition) WHERE p.kind = 'audio' GROUP BY 1),
b AS (SELECT *, CASE WHEN ot IS NULL OR got IS NULL THEN 'no-type' WHEN ot = got THEN CASE WHEN rep AND ot NOT IN (5, 29) THEN 'sbr-undeclared' ELSE 'type-agrees' END WHEN ot IN (5, 29) AND got = 2 THEN 'he-over-lc' WHEN (rep OR got IN (5, 29)) AND ot NOT IN (5, 29) THEN 'sbr-undeclared' ELSE 'type-differs' END AS rule FROM a)""",
    _rows(
        "codecstring",
        ("undecomposable", _R, "OK", "li", "w WHERE dp IS NULL"),
        (_case(("dp < pi", "profile-understated"), other="profile-overstated"), _R, _case(("dp < pi", "BAD"), other="WARN"), "pi", "w WHERE dp <> pi"),
        (_case(("dl < li", "level-understated"), other="level-overstated"), _R, _case(("dl < li", "BAD"), other="WARN"), "li", "w WHERE dl <> li"),
        ("tier-differs", _R, "WARN", "ti", "w WHERE dt <> ti"),
        ("agrees", _R, "OK", "li", "w WHERE dp = pi AND dl = li AND coalesce(dt = ti, TRUE)"),
        ("rule", _R, _case(("rule = 'sbr-undeclared'", "BAD"), ("rule = 'type-differs'", "WARN"), other="OK"), "got", "b"),
    ),
)

SQL["videorange"] = _with(
    "g AS (SELECT p.rendition, r.transfer AS said, video_range, arg_min(p.transfer, sequence) FILTER (WHERE p.transfer IS NOT NULL) AS t FROM p JOIN r USING (rendition) WHERE p.kind = 'video' GROUP BY 1, 2, 3), j AS (SELECT *, CASE WHEN t IN (0, 2, 3) THEN NULL WHEN t = 16 THEN 'PQ' WHEN t = 18 THEN 'HLG' ELSE 'SDR' END AS rng FROM g)",
    _rows("videorange", (_case(("t IS NULL", "unstated"), ("said <> t", "transfer"), ("video_range <> rng", "range"), other="agrees"), _R, _case(("t IS NOT NULL AND (said <> t OR video_range <> rng)", "BAD"), other="OK"), "t", "j")),
)

SQL["clear"] = _with(
    """c AS (SELECT p.*, q.scheme AS said, sum(CASE WHEN encrypted_samples > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rendition ORDER BY sequence) AS begun FROM p JOIN r q USING (rendition)),
g AS (SELECT rendition, bool_or(key_declared OR encrypted OR said IS NOT NULL) AS claims, count(encrypted_samples) AS known, sum(encrypted_samples) AS enc, sum(CASE WHEN begun = 0 THEN floor(clear_samples * frame_dur * CAST(1000000 AS DOUBLE) / timescale) ELSE 0 END) AS lead, count(*) FILTER (WHERE begun = 0 AND clear_samples > 0 AND frame_dur IS NULL) AS untold FROM c GROUP BY 1),
h AS (SELECT *, untold = 0 AND abs(lead - 2000000) > 100000 AS off FROM g WHERE claims)""",
    _rows("clear", (_case(("known = 0", "unknown"), ("enc = 0", "nothing-encrypted"), ("off", "lead"), ("untold > 0", "lead-unknown"), other="encrypted"), _R, _case(("known = 0", "OK"), ("enc = 0 OR off", "BAD"), other="OK"), "CASE WHEN known > 0 AND untold = 0 THEN round(lead / 1000000, 3) END", "h")),
)

SQL["scheme"] = _with(
    """g AS (SELECT p.stream, p.rendition, p.kind, r.scheme AS said, arg_min(p.scheme, sequence) AS f, arg_min(crypt_pattern, sequence) AS pat FROM p JOIN r USING (rendition) WHERE p.scheme IS NOT NULL GROUP BY 1, 2, 3, 4),
j AS (SELECT *, CASE WHEN pat AND f NOT IN ('cbcs', 'cens') THEN 'pattern-without' WHEN f IN ('cbcs', 'cens') AND kind = 'video' AND NOT pat THEN 'pattern-missing' WHEN said <> f THEN 'differs' ELSE 'agrees' END AS rule FROM g)""",
    _rows("scheme", ("rule", _R, _case(("rule = 'agrees'", "OK"), other="BAD"), "NULL", "j"), ("ladder", f"{_S} || 'ladder'", "BAD", "n", "(SELECT stream, count(DISTINCT f) AS n FROM g GROUP BY stream) WHERE n > 1")),
)

SQL["drm"] = _with(
    """d AS (SELECT DISTINCT rendition, unnest(drm) AS sys FROM p JOIN r USING (rendition)), h AS (SELECT DISTINCT rendition, unnest(pssh) AS sys FROM p),
u AS (SELECT rendition FROM d UNION SELECT rendition FROM h)""",
    _rows(
        "drm",
        ("missing", "'r' || rendition || '/' || sys", "BAD", "NULL", "(SELECT * FROM d EXCEPT SELECT * FROM h) WHERE rendition IN (SELECT rendition FROM h)"),
        ("no-pssh", _R, "OK", "NULL", "u WHERE rendition NOT IN (SELECT rendition FROM h)"),
        ("undeclared", "'r' || rendition || '/' || sys", "WARN", "NULL", "(SELECT * FROM h EXCEPT SELECT * FROM d)"),
        ("agrees", _R, "OK", "NULL", "u WHERE rendition IN (SELECT rendition FROM h) AND rendition NOT IN (SELECT rendition FROM (SELECT * FROM d EXCEPT SELECT * FROM h)) AND rendition NOT IN (SELECT rendition FROM (SELECT * FROM h EXCEPT SELECT * FROM d))"),
    ),
)

#: Openings that are known, that are no keyframe for certain, and that are not settled.
_OPEN = """rendition, count(*) AS n, count(*) FILTER (WHERE known) AS verified, count(*) FILTER (WHERE known AND NOT opens_keyframe AND sure) AS bad, count(*) FILTER (WHERE known AND NOT opens_keyframe AND NOT sure) AS unsettled, min(sequence) FILTER (WHERE known AND NOT opens_keyframe AND sure) AS sequence, count(*) FILTER (WHERE pictures > 1) AS several
  FROM (SELECT *, opens_keyframe IS NOT NULL AND NOT opaque AS known, container = 'mp4' OR has_keyframe = FALSE AS sure FROM p) GROUP BY rendition"""
SQL["iframe"] = _with(
    f"""o AS (SELECT {_OPEN.replace("FROM p)", "FROM p WHERE kind = 'iframe')")}),
b AS (SELECT p.stream, p.rendition, p.kind, r.width, r.height, arg_min(CAST(floor(min_pts * CAST(1000000 AS DOUBLE) / timescale) AS BIGINT), sequence) AS start FROM p JOIN r USING (rendition) WHERE min_pts IS NOT NULL AND p.kind IN ('video', 'iframe') GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT i.stream, i.rendition, i.start, v.start AS video, row_number() OVER (PARTITION BY i.rendition ORDER BY coalesce(i.width = v.width AND i.height = v.height, FALSE) DESC, CASE WHEN i.width = v.width AND i.height = v.height THEN -v.rendition ELSE v.rendition END) AS rk FROM b i JOIN b v ON v.stream = i.stream AND v.kind = 'video' WHERE i.kind = 'iframe'),
md AS (SELECT stream, rendition, measured_us, row_number() OVER (PARTITION BY rendition ORDER BY measured_us) AS rk, count(*) OVER (PARTITION BY rendition) AS n FROM p WHERE measured_us > 0),
slack AS (SELECT stream, arg_min(measured_us, rendition) AS slack FROM md WHERE rk = n // 2 + 1 GROUP BY stream),
t AS (SELECT rendition, start - video AS drift, abs(start - video) <= coalesce(slack, 2000000) AS ok FROM n LEFT JOIN slack USING (stream) WHERE rk = 1)""",
    _rows(
        "iframe",
        ("empty", _R, "ERROR", "NULL", "r WHERE kind = 'iframe' AND rendition NOT IN (SELECT rendition FROM s)"),
        ("unreadable", _R, "BAD", "count(*)", "s WHERE kind = 'iframe' AND NOT parsed GROUP BY rendition"),
        ("no-keyframe", _P, "BAD", "bad", "o WHERE bad > 0"),
        ("several-pictures", _R, "WARN", "several", "o WHERE several > 0"),
        ("unverified", _R, "OK", "n", "o WHERE bad = 0 AND verified = 0"),
        (_case(("unsettled > 0", "unsettled"), other="opens"), _R, "OK", "verified", "o WHERE bad = 0 AND verified > 0"),
        (_case(("ok", "same-timeline"), other="other-timeline"), _R, _case(("ok", "OK"), other="BAD"), "drift / CAST(1000 AS DOUBLE)", "t"),
    ),
)

_TIERS = ", ".join(f"({i}, {w * h}, {k})" for i, (w, h, k) in enumerate(AVC_TIERS))
SQL["profile"] = _with(
    _RATES + f""", d AS (SELECT p.stream, rendition, p.kind, measured_us, sequence, live, count(*) OVER w AS n, max(sequence) OVER w AS last, arg_min(measured_us, sequence) OVER w AS first_us FROM p JOIN r USING (rendition) WHERE p.kind <> 'text' AND measured_us > 0 WINDOW w AS (PARTITION BY rendition)),
kd AS (SELECT rendition, measured_us, row_number() OVER (PARTITION BY rendition ORDER BY measured_us) AS rk, count(*) OVER (PARTITION BY rendition) AS n FROM d WHERE NOT (NOT live AND n > 1 AND sequence = last AND measured_us < first_us)),
us AS (SELECT rendition, max(n) AS n, max(CASE WHEN rk = n // 2 + 1 THEN measured_us END) AS usual, min(measured_us) AS low, max(measured_us) AS high FROM kd GROUP BY 1 HAVING max(n) > 1),
up AS (SELECT *, CAST(greatest(usual - low, high - usual) AS DOUBLE) * 100 / usual AS pct FROM us),
vd AS (SELECT stream, rendition, measured_us, row_number() OVER (PARTITION BY rendition ORDER BY measured_us) AS rk, count(*) OVER (PARTITION BY rendition) AS n FROM d WHERE kind = 'video'),
vu AS (SELECT stream, rendition, measured_us AS usual FROM vd WHERE rk = n // 2 + 1),
en AS (SELECT stream, arg_min(rendition, (usual, rendition)) AS lr, min(usual) AS low, arg_min(rendition, (-usual, rendition)) AS hr, max(usual) AS high FROM vu GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT {_OPEN.replace("FROM p)", f"FROM p WHERE kind = 'video' AND rendition IN (SELECT rendition FROM {_RI}))")}),
sz AS (SELECT p.rendition, coalesce(arg_min(p.width * p.height, sequence) FILTER (WHERE p.width > 0), max(r.width * r.height)) AS px, arg_min(codec, sequence) FILTER (WHERE codec IS NOT NULL) AS codec FROM p JOIN r USING (rendition) WHERE p.kind = 'video' GROUP BY 1),
tiers(i, tpx, kbps) AS (VALUES {_TIERS}),
near AS (SELECT rendition, codec, kbps, row_number() OVER (PARTITION BY rendition ORDER BY abs(ln(CAST(px AS DOUBLE) / tpx)), i) AS rk FROM sz CROSS JOIN tiers WHERE px > 0),
tier AS (SELECT rendition, CASE WHEN codec IS NULL OR codec = 'h264' THEN av / (kbps * 1000) END AS share FROM rates JOIN near USING (rendition) WHERE kind = 'video' AND rk = 1),
fr AS (SELECT stream, rendition, fps, row_number() OVER (PARTITION BY rendition ORDER BY fps) AS rk, count(*) OVER (PARTITION BY rendition) AS n FROM (SELECT *, CAST(floor(CAST(timescale * 1000 AS DOUBLE) / frame_dur) AS BIGINT) AS fps FROM p WHERE kind = 'video' AND frame_dur > 0 AND rendition IN (SELECT rendition FROM {_RI}))),
fu AS (SELECT stream, rendition, max(CASE WHEN rk = n // 2 + 1 THEN fps END) AS usual, min(fps) AS low, max(fps) AS high FROM fr GROUP BY 1, 2),
fw AS (SELECT *, CASE WHEN usual - low >= high - usual THEN low ELSE high END AS worst, max(usual) OVER (PARTITION BY stream) / CAST(usual AS DOUBLE) AS ratio FROM fu),
fo AS (SELECT *, abs(worst - usual) * 100 > usual * 2 AS off, abs(ratio - greatest(floor(ratio + 0.5), 1)) * 100 > greatest(floor(ratio + 0.5), 1) * 2 AS odd FROM fw),
fl AS (SELECT stream, count(*) AS n, count(*) FILTER (WHERE odd) AS odd, count(*) FILTER (WHERE off) AS off, max(usual) AS top FROM fo GROUP BY 1)""",
    _rows(
        "profile",
        ("'apple:peak-vs-average'", _R, _case(("peak / av > 2", "WARN"), other="OK"), "round(peak / av, 6)", "rates WHERE kind = 'video'"),
        ("'apple:segment-duration'", _R, _case(("pct > 10", "WARN"), other="OK"), "CASE WHEN pct > 10 THEN round(pct, 6) ELSE usual / 1e6 END", "up"),
        ("'apple:segment-duration'", f"{_S} || 'ladder:r' || lr || ':r' || hr", "WARN", "(high - low) / CAST(1000 AS DOUBLE)", "en WHERE (high - low) * 100 > low * 10"),
        ("'apple:idr-per-segment'", f"CASE WHEN bad > 0 THEN {_P} ELSE {_R} END", _case(("bad > 0", "WARN"), other="OK"), "CASE WHEN bad > 0 THEN bad WHEN unsettled > 0 THEN unsettled ELSE verified END", "o WHERE verified > 0"),
        ("'apple:bitrate-tier'", _R, _case(("share < 0.5 OR share > 2", "WARN"), other="OK"), "round(share, 6)", "tier"),
        ("'apple:frame-rate'", _R, "WARN", "worst / CAST(1000 AS DOUBLE)", "fo WHERE off"),
        ("'apple:frame-rate'", f"{_S} || 'ladder'", _case(("odd > 0", "WARN"), other="OK"), "CASE WHEN odd > 0 THEN odd ELSE top / CAST(1000 AS DOUBLE) END", "fl WHERE n > 1 AND (odd > 0 OR off = 0)"),
    ),
)

SQL["continuity"] = _with(
    _PAIR.format(src="(SELECT * FROM p WHERE kind <> 'text')") + """, c AS (SELECT *, adjacent AND timescale = lt AND lm IS NOT NULL AS compared FROM pair), f AS (SELECT *, coalesce(compared AND abs(drift) > 100000 * timescale, FALSE) AS off FROM c),
g AS (SELECT rendition, sum(cc_errors) AS br, count(*) FILTER (WHERE compared) AS n, count(*) FILTER (WHERE off AND NOT discontinuity) AS bad FROM f GROUP BY 1)""",
    _rows(
        "continuity",
        (_case(("discontinuity", "declared-discontinuity"), ("drift > 0", "gap"), other="overlap"), _P, _case(("discontinuity", "OK"), other="BAD"), "CAST(drift AS DOUBLE) / (timescale * 1000)", "f WHERE off"),
        ("counter", _R, "BAD", "br", "g WHERE br > 0"),
        ("continuous", _R, "OK", "n", "g WHERE br = 0 AND n > 0 AND bad = 0"),
    ),
)

SQL["discontinuity"] = _with(
    _PAIR.format(src="(SELECT * FROM p WHERE kind NOT IN ('text', 'iframe'))") + """, idle AS (SELECT * FROM pair WHERE discontinuity AND adjacent AND abs(drift) <= 100000 * timescale AND codec IS NOT DISTINCT FROM lc AND width IS NOT DISTINCT FROM lw AND height IS NOT DISTINCT FROM lh),
lead AS (SELECT stream, sequence, min_pts AS lpts, discontinuity_sequence AS lds, rendition AS lr FROM pair WHERE rendition IN (SELECT min(rendition) FROM pair GROUP BY stream)),
apart AS (SELECT rendition, sequence FROM pair JOIN lead USING (stream, sequence) WHERE rendition <> lr AND abs(min_pts - lpts) * 1000000 <= 100000 * timescale AND discontinuity_sequence <> lds)""",
    _rows(
        "discontinuity",
        ("nothing-changes", _P, "BAD", "sequence", "idle"),
        ("sequence-differs", _R, "BAD", "min(sequence)", "apart GROUP BY rendition"),
        ("declared", _R, "OK", "count(*)", "pair WHERE discontinuity AND rendition NOT IN (SELECT rendition FROM idle) AND rendition NOT IN (SELECT rendition FROM apart) GROUP BY rendition"),
    ),
)

SQL["duration"] = _with(
    """m AS (SELECT rendition, sequence, declared_us, measured_us, CAST(measured_us - declared_us AS DOUBLE) * 100 / declared_us AS pct FROM p WHERE kind <> 'text' AND declared_us > 0 AND measured_us IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY rendition ORDER BY abs(pct) DESC, sequence) AS rk FROM m),
g AS (SELECT rendition, CAST(sum(measured_us) - sum(declared_us) AS DOUBLE) * 100 / sum(declared_us) AS total FROM m GROUP BY 1)""",
    _rows(
        "duration",
        ("over-target", _P, "BAD", "declared_us / 1e6", "s JOIN r USING (rendition) WHERE s.kind <> 'text' AND declared_us > target_us + 500000"),
        ("segment-drift", _P, "WARN", "pct", "k WHERE rk = 1 AND abs(pct) > 5"),
        ("total-drift", _R, _case(("abs(total) > 5", "WARN"), other="OK"), "total", "g"),
    ),
)

SQL["timeline"] = _with(
    "t AS (SELECT *, min_pts * 1000000 - declared_start_us * timescale AS drift FROM p WHERE declared_start_us IS NOT NULL)",
    _rows("timeline", ("start", _P, "BAD", "CAST(drift AS DOUBLE) / (timescale * 1000)", "t WHERE abs(drift) > 100000 * timescale"), ("agrees", _R, "OK", "count(*)", "t GROUP BY rendition HAVING max(abs(drift) - 100000 * timescale) <= 0")),
)

SQL["alignment"] = _with(
    "g AS (SELECT stream, period, sequence, max(min_pts) - min(min_pts) AS spread FROM p WHERE kind = 'video' GROUP BY 1, 2, 3 HAVING count(*) > 1)",
    _rows("alignment", ("spread", f"{_S} || 'p' || period || '/' || sequence", "BAD", "CAST(spread AS DOUBLE) / 90", "g WHERE spread * 1000000 > 9000000000"), ("aligned", f"{_S} || 'ladder'", "OK", "n", "(SELECT stream, count(*) AS n, max(spread) AS m FROM g GROUP BY stream) WHERE n > 0 AND m * 1000000 <= 9000000000")),
)

SQL["pdt"] = _with(
    _PAIR.format(src="(SELECT * FROM p WHERE kind <> 'text' AND pdt_us IS NOT NULL)") + """, c AS (SELECT *, pdt_us - lclock AS clock, (pdt_us - lclock) * timescale - (min_pts - lp) * 1000000 AS off FROM pair WHERE adjacent),
back AS (SELECT rendition, min(sequence) AS sequence, count(*) AS n FROM c WHERE clock <= 0 GROUP BY 1),
dr AS (SELECT *, row_number() OVER (PARTITION BY rendition ORDER BY abs(off) DESC, sequence) AS rk FROM c WHERE NOT discontinuity AND abs(off) > 100000 * timescale),
lad AS (SELECT stream, sequence, max(min_pts) - min(min_pts) AS media, max(pdt_us - min_pts * 1000000 // timescale) - min(pdt_us - min_pts * 1000000 // timescale) AS spread FROM pair WHERE kind = 'video' GROUP BY 1, 2 HAVING count(*) > 1)""",
    _rows(
        "pdt",
        ("backwards", _P, "BAD", "n", "back"),
        ("drift", _P, "BAD", "CAST(off AS DOUBLE) / (timescale * 1000)", "dr WHERE rk = 1"),
        ("agrees", _R, "OK", "count(*)", "c WHERE rendition NOT IN (SELECT rendition FROM back) AND rendition NOT IN (SELECT rendition FROM dr) GROUP BY rendition"),
        ("ladder", f"{_S} || 'seq' || sequence", "BAD", "spread / CAST(1000 AS DOUBLE)", "lad WHERE media * 1000000 <= 9000000000 AND spread > 100000"),
    ),
)

_FOLD = "(CASE WHEN {0} > 4294967296 THEN {0} - 8589934592 WHEN {0} < -4294967296 THEN {0} + 8589934592 ELSE {0} END)".format

SQL["parts"] = _with(
    f"""x AS (SELECT parts.*, part_target_us FROM parts JOIN r USING (rendition)),
ok AS (SELECT *, lag(idx) OVER o AS pi, {_FOLD("(min_pts - lag(min_pts) OVER o)")} * 1000000 - lag(declared_us) OVER o * timescale AS drift FROM x WHERE parsed WINDOW o AS (PARTITION BY rendition, sequence ORDER BY idx)),
e AS (SELECT rendition, sequence, min(idx) AS i0, max(idx) AS i1, count(*) AS n, arg_min(min_pts, idx) AS p0, arg_max(min_pts, idx) AS p1, arg_max(declared_us, idx) AS d1 FROM ok GROUP BY 1, 2),
f AS (SELECT e.*, {_FOLD("(p0 - min_pts)")} * 1000000 AS early, {_FOLD("(p1 - min_pts)")} * 1000000 + (d1 - measured_us) * 90000 AS late FROM e JOIN p USING (rendition, sequence) WHERE i0 = 0)""",
    _rows(
        "parts",
        ("unreadable", _P + " || '/' || idx", "BAD", "NULL", "x WHERE NOT parsed"),
        ("not-independent", _P + " || '/' || idx", "BAD", "NULL", "ok WHERE independent AND NOT opens_keyframe"),
        ("drift", _P + " || '/' || idx", "BAD", "CAST(drift AS DOUBLE) / (timescale * 1000)", "ok WHERE pi = idx - 1 AND abs(drift) > 100000 * timescale"),
        ("segment-start", _P, "BAD", "early / CAST(90000000 AS DOUBLE)", "f WHERE abs(early) > 9000000000"),
        ("segment-end", _P, "BAD", "late / CAST(90000000 AS DOUBLE)", "f WHERE n = i1 + 1 AND abs(late) > 9000000000"),
        ("over-target", _P + " || '/' || idx", "BAD", "declared_us / 1e6", "ok WHERE declared_us > part_target_us + 100000"),
    ),
)

SQL["subtitles"] = _with(
    """org AS (SELECT stream, min(CAST(floor(min_pts * CAST(1000000 AS DOUBLE) / timescale) AS BIGINT)) AS o FROM p WHERE kind = 'video' GROUP BY stream),
t0 AS (SELECT rendition, sequence, declared_us, mapped, parsed, o, coalesce(o, 0) + coalesce(sum(declared_us) OVER (PARTITION BY rendition ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM s LEFT JOIN org USING (stream) WHERE kind = 'text'),
t AS (SELECT * FROM t0 WHERE parsed),
c AS (SELECT t.*, begin_us - since AS d, begin_us < since - 100000 OR end_us > since + declared_us + 100000 AS off FROM t JOIN cues USING (rendition, sequence)),
g AS (SELECT rendition, bool_or(mapped) AS mapped, max(o) AS o, (SELECT count(*) FROM c WHERE c.rendition = t.rendition) AS n, coalesce((SELECT bool_or(off) FROM c WHERE c.rendition = t.rendition), FALSE) AS bad FROM t GROUP BY rendition)""",
    _rows(
        "subtitles",
        ("outside", _P, "BAD", "min(d) / 1e6", "c WHERE off GROUP BY rendition, sequence"),
        (_case(("n = 0", "no-cues"), ("NOT mapped", "no-map"), ("o IS NULL", "no-origin"), other="inside"), _R, _case(("n = 0 OR NOT mapped", "WARN"), other="OK"), "n", "g WHERE NOT bad"),
    ),
)

SQL["adbreak"] = _with(
    f"""v AS (SELECT * FROM p WHERE kind = 'video'),
sp AS (SELECT rendition, arg_min(min_pts, sequence) AS first, arg_max(min_pts, sequence) AS lp, max(sequence) AS ms, arg_min(pdt_us, sequence) FILTER (WHERE pdt_us IS NOT NULL) AS ac, arg_min(min_pts, sequence) FILTER (WHERE pdt_us IS NOT NULL) AS ap FROM v GROUP BY 1),
e AS (SELECT rendition, {_FOLD("(min_pts - first)")} AS edge FROM v JOIN sp USING (rendition)
  UNION ALL SELECT sp.rendition, {_FOLD("(lp - first)")} + CAST(floor(measured_us * CAST(90000 AS DOUBLE) / 1000000) AS BIGINT) FROM sp JOIN v ON v.rendition = sp.rendition AND v.sequence = ms WHERE measured_us IS NOT NULL),
w0 AS (SELECT b.*, first, coalesce(media_pts, CAST(floor(media_us * CAST(90000 AS DOUBLE) / 1000000) AS BIGINT), v.min_pts, ap + CAST(floor((clock_us - ac) * CAST(90000 AS DOUBLE) / 1000000) AS BIGINT)) AS pt FROM breaks b JOIN sp USING (rendition) LEFT JOIN v ON v.rendition = b.rendition AND v.sequence = at_sequence),
pts AS (SELECT rendition, 'r' || rendition || '@b' || break AS name, 'break' AS what, {_FOLD("(pt - first)")} AS pos FROM w0
  UNION ALL SELECT rendition, 'r' || rendition || '@' || splice, 'splice', {_FOLD("(pts - first)")} FROM splices JOIN sp USING (rendition)),
j AS (SELECT name, what, min(abs(pos - edge)) AS away, min(edge) <= pos AND max(edge) >= pos AS inside FROM pts JOIN e USING (rendition) WHERE pos IS NOT NULL GROUP BY name, what, pos),
one AS (SELECT rendition, event, arg_min(pts, splice) AS pts FROM splices WHERE pts IS NOT NULL GROUP BY 1, 2),
told AS (SELECT b.rendition, break, {_FOLD("(section_pts - pts)")} AS off FROM breaks b JOIN one USING (rendition, event) JOIN sp ON sp.rendition = b.rendition WHERE section_pts IS NOT NULL)""",
    _rows(
        "adbreak",
        ("what || CASE WHEN away > 9000 THEN '-off-boundary' ELSE '-on-boundary' END", "name", _case(("away > 9000", "BAD"), other="OK"), "away / CAST(90 AS DOUBLE)", "j WHERE inside OR away <= 9000"),
        ("section-differs", "'r' || rendition || '@b' || break", "BAD", "off / CAST(90 AS DOUBLE)", "told WHERE abs(off) > 9000"),
        ("untimed", _R, "OK", "count(*)", "pts WHERE pos IS NULL GROUP BY rendition"),
    ),
)

SQL["period"] = _with(
    """d AS (SELECT *, min_pts * 1000000 - declared_start_us * timescale AS drift FROM p WHERE declared_start_us IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY rendition, period ORDER BY abs(drift), sequence) AS rk FROM d),
b AS (SELECT stream, period, drift, row_number() OVER (PARTITION BY stream, period ORDER BY abs(drift) DESC, rendition) AS rk FROM a WHERE rk = 1),
f AS (SELECT stream, arg_min(drift, period) AS base, min(period) AS first FROM b WHERE rk = 1 GROUP BY stream),
c AS (SELECT stream, period, CAST(drift - base AS DOUBLE) / 90000000 AS ms FROM b JOIN f USING (stream) WHERE rk = 1 AND period <> first),
l AS (SELECT rendition, period, string_agg(DISTINCT codec, ',' ORDER BY codec) AS codecs, string_agg(DISTINCT width || 'x' || height, ',' ORDER BY width || 'x' || height) AS sizes FROM p WHERE kind = 'video' GROUP BY 1, 2),
m AS (SELECT *, lag(codecs) OVER o AS pc, lag(sizes) OVER o AS ps FROM l WINDOW o AS (PARTITION BY rendition ORDER BY period))""",
    _rows(
        "period",
        (_case(("ms > 500 OR ms < -2500", "drift"), other="placed"), f"{_S} || 'p' || period", _case(("ms > 500 OR ms < -2500", "BAD"), other="OK"), "ms", "c"),
        ("codecs-change", "'r' || rendition || '/p' || period", "BAD", "NULL", "m WHERE pc <> codecs"),
        ("sizes-change", "'r' || rendition || '/p' || period", "WARN", "NULL", "m WHERE ps <> sizes"),
    ),
)

#: The search once more, round by round: the oldest place first, then four halvings.
_HALVES = "\n".join(f"""h{k} AS (SELECT h.rendition, CASE WHEN low > high OR kept THEN low ELSE (low + high) // 2 + 1 END AS low, CASE WHEN low <= high AND kept THEN (low + high) // 2 - 1 ELSE high END AS high, CASE WHEN low <= high AND kept THEN (low + high) // 2 ELSE found END AS found
  FROM h{k - 1} h LEFT JOIN pt ON pt.rendition = h.rendition AND pt.k = (low + high) // 2),""" for k in range(1, 5))
SQL["dvr"] = _with(
    f"""top AS (SELECT rendition, row_number() OVER (PARTITION BY stream ORDER BY bandwidth DESC, rendition DESC) AS rk FROM r WHERE live AND kind = 'video' AND rendition IN (SELECT rendition FROM s)),
ws AS (SELECT s.*, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY rendition) AS n, sum(declared_us) OVER (PARTITION BY rendition) AS whole FROM s JOIN top USING (rendition) WHERE rk = 1 WINDOW o AS (PARTITION BY rendition ORDER BY sequence)),
asked AS (SELECT * FROM ws WHERE n <= 16 OR k = 0 OR floor(k * 15 / (n - 1)) > floor((k - 1) * 15 / (n - 1))),
pt AS (SELECT rendition, sequence, declared_us, kept AND parsed AS kept, whole, row_number() OVER (PARTITION BY rendition ORDER BY sequence) - 1 AS k, count(*) OVER (PARTITION BY rendition) AS n, lead(sequence) OVER (PARTITION BY rendition ORDER BY sequence) - sequence AS step FROM asked),
h0 AS (SELECT rendition, 0 AS low, n - 1 AS high, -1 AS found FROM pt WHERE k = 0 AND NOT kept AND n > 1),
{_HALVES}
since AS (SELECT h.rendition, found, CASE WHEN found < 0 THEN 0 WHEN found = max(n) - 1 THEN arg_max(declared_us, k) ELSE sum(greatest(step, 1) * declared_us) FILTER (WHERE k >= found AND k < n - 1) END AS since FROM h4 h JOIN pt USING (rendition) GROUP BY 1, 2)""",
    _rows("dvr", (_case(("kept", "held"), other="gone"), _R, _case(("kept", "OK"), other="BAD"), "CASE WHEN kept THEN whole ELSE since END / 1e6", "pt LEFT JOIN since USING (rendition) WHERE k = 0")),
)

SQL["availability"] = _with(
    "g AS (SELECT s.rendition, max(sequence) - coalesce(max(sequence) FILTER (WHERE fetched), min(sequence) - 1) AS run FROM s JOIN r USING (rendition) WHERE live AND format = 'dash' GROUP BY 1)",
    _rows(
        "availability",
        (_case(("run > 0", "newest-missing"), other="there"), _R, _case(("run > 0", "BAD"), other="OK"), "run", "g"),
        (_case(("abs(skew_us) > 1000000", "clock-off"), ("skew_us IS NOT NULL", "clock-agrees"), ("sources > 0 AND NOT spoken", "clock-unsupported"), ("sources > 0", "clock-silent"), other="no-clock"), f"{_S} || 'clock'", _case(("abs(skew_us) > 1000000", "WARN"), other="OK"), "skew_us / 1e6", "(SELECT DISTINCT stream FROM r WHERE live AND format = 'dash') LEFT JOIN clocks USING (stream)"),
        ("next-served", _R, "WARN", "NULL", "ahead JOIN r USING (rendition) WHERE served"),
    ),
)

SQL["watch"] = _with(
    """o AS (SELECT *, uris[len(uris)] AS newest FROM observations WHERE NOT failed),
a AS (SELECT *, lag(uris) OVER w AS was, lag(newest) OVER w AS last, row_number() OVER w AS nth, coalesce(last_value(newest IGNORE NULLS) OVER (PARTITION BY rendition ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS shown FROM o WINDOW w AS (PARTITION BY rendition ORDER BY poll)),
b AS (SELECT *, nth > 1 AND newest IS NOT NULL AND newest <> shown AS moved, CASE WHEN last IS NOT NULL AND list_position(uris, last) > 0 THEN coalesce(list_sum(durations_us[list_position(uris, last) + 1 :]), 0) END AS published,
  coalesce(newest <> last AND list_position(was, newest) > 0 AND list_position(was, newest) < list_position(was, last), FALSE) AS back FROM a),
c AS (SELECT *, observed_us - coalesce(max(CASE WHEN moved THEN observed_us END) OVER (PARTITION BY rendition ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(observed_us) OVER (PARTITION BY rendition)) AS gap, CASE WHEN published IS NOT NULL THEN list_max(durations_us) END AS one FROM b),
g AS (SELECT rendition, count(*) AS looks, count(newest) AS full_looks, count(*) FILTER (WHERE moved) AS adv, max(gap) AS stall, bool_or(back) AS back, max(target_us) AS target, max(observed_us) - min(observed_us) AS passed, CAST(sum(published) AS BIGINT) AS media, max(one) AS one FROM c GROUP BY 1),
h AS (SELECT *, media - passed AS ahead FROM g WHERE looks > 1 AND adv > 0 AND NOT back AND media IS NOT NULL AND one > 0 AND passed >= 4 * one),
f AS (SELECT rendition, count(*) FILTER (WHERE failed) AS failed, count(*) AS n FROM observations GROUP BY 1),
j AS (SELECT *, CASE WHEN looks = 1 THEN 'one-look' WHEN full_looks = 0 THEN 'empty' WHEN adv = 0 THEN 'never-advanced' WHEN target IS NULL THEN 'no-interval' WHEN stall > target * 3 THEN 'stalled' ELSE 'advancing' END AS rule FROM g)""",
    _rows(
        "watch",
        ("rule", _R, _case(("rule IN ('empty', 'never-advanced', 'stalled')", "BAD"), other="OK"), "CASE WHEN rule IN ('empty', 'never-advanced') THEN passed WHEN rule <> 'one-look' THEN stall END / 1e6", "j"),
        ("backwards", _R, "BAD", "NULL", "g WHERE back AND looks > 1 AND adv > 0"),
        (_case(("ahead < 0", "behind"), other="ahead"), _R, _case(("ahead < 0", "BAD"), other="WARN"), "abs(ahead) / 1e6", "h WHERE abs(ahead) > one + passed / CAST(5 AS DOUBLE)"),
        (_case(("failed = n", "all-failed"), other="poll-failed"), _R, "ERROR", "failed", "f WHERE failed > 0"),
    ),
)
