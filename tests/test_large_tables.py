"""What must hold so that jobs grow no faster than their tables, and rules that small numbers never reach."""

import duckdb
from conftest import SF, rows_of

from mediaprism.operators.registry import load, run_checks
from mediaprism.plans import stream, synthetic, synthetic_dash
from mediaprism.queries import QUERIES, SQL
from mediaprism.sources.fetch import from_corpus


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_of_several_checks_are_read_not_one_plan(spark):
    plan = _plan(run_checks(load(spark, SF), ["fetch", "ladder"]))
    assert "Relation" in plan and "Join" not in plan and "Aggregate" not in plan


def test_media_are_made_once(spark):
    _, corpus, edge = synthetic.streams(spark, SF)
    for made in (corpus, edge, synthetic_dash.presentations(spark, SF)[1]):
        assert "MapInArrow" not in _plan(made) and "MapInPandas" not in _plan(made) and "Join" not in _plan(made)


def test_ranges_of_one_body_meet_it_once(spark):
    body = bytes(range(256)) * 8
    corpus = spark.createDataFrame([("a", 200, body), ("b", 404, b"gone")], "uri string, status int, body binary")
    asked = spark.createDataFrame([(k, "a", k, 3) for k in range(2000)] + [(2000, "a", None, None), (2001, "a", None, 2), (2002, "b", 0, 2), (2003, "c", 0, 2), (2004, None, None, None), (2005, "a", 2047, 9)], "n long, uri string, offset long, length long")
    answers = from_corpus(asked, corpus)
    got = {r["n"]: (r["status"], None if r["body"] is None else bytes(r["body"]), r["error"]) for r in answers.collect()}
    assert len(got) == 2006 and all(got[k] == (206, body[k : k + 3], None) for k in range(2000))
    assert got[2000] == (200, body, None) and got[2001] == (206, body[:2], None) and got[2002] == (404, b"go", "status 404")
    assert got[2003] == got[2004] == (None, None, "no answer") and got[2005] == (206, body[2047:], None)
    assert "_asks" in _plan(answers)


def test_functions_of_large_numbers_agree_with_sql(spark, tmp_path):
    ids = [0, 2047, 2048, 2_097_151, 2_097_152, 2_202_010, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["functions"](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(c.execute(SQL["functions"]).df()) and (got["bytes"].str.endswith("TiB")).sum() == 3


def test_playlists_without_a_bandwidth(spark, duck):
    got = QUERIES["manifest"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(SQL["manifest"]).df()) and "unusable" in set(got["rule"])


def test_only_variants_have_to_state_a_bandwidth(spark):
    site = "https://h/"
    master = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="x",URI="a.m3u8"\n#EXT-X-STREAM-INF:CODECS="avc1.64001f",AUDIO="a"\nv.m3u8\n'
    media = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXTINF:2,\n1.ts\n#EXT-X-ENDLIST\n"
    lists = spark.createDataFrame([(1, site + "m.m3u8", master), (2, site + "alone.m3u8", media)], "manifest_id long, url string, body string")
    corpus = spark.createDataFrame([(site + u, 200, media.encode()) for u in ("a.m3u8", "v.m3u8")], "uri string, status int, body binary")
    found = stream.hls_listing(lists, lambda asked: from_corpus(asked, corpus)).renditions.select("stream", "kind", "bandwidth").collect()
    assert {(r["stream"], r["kind"], r["bandwidth"]) for r in found} == {(1, "audio", None), (1, "video", 0), (2, "video", None)}
