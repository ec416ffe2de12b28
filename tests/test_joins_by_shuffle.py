"""What grows with the input is never sent whole through the driver, however small its compressed files look."""

import pytest
from conftest import SF

from mediaprism.operators.registry import CHECKS, load, shared
from mediaprism.sources import fetch, hls


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def written(spark):
    return shared(load(spark, SF))


@pytest.mark.parametrize("name", "manifest fetch resolution pop profile parts adbreak".split())
def test_checks_send_no_rows_of_segments_and_renditions_through_the_driver(written, name, capsys):
    plan = plan_of(CHECKS[name](written), capsys)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_requests_and_what_they_carry_meet_bodies_by_a_shuffle(spark, tmp_path, monkeypatch, capsys):
    """Of few requests the addresses alone are sent to the bodies; answers are the same either way."""
    spark.range(40).selectExpr("concat('u', id) AS uri", "200 AS status", "cast(concat('body', id) AS binary) AS body").write.parquet(f"{tmp_path}/corpus")
    spark.range(60).selectExpr("concat('u', id) AS uri", "if(id % 2 = 0, 4L, null) AS offset", "if(id % 2 = 0, 1L, null) AS length", "repeat('carried', 9) AS more").write.parquet(f"{tmp_path}/asked")
    corpus, asked = spark.read.parquet(f"{tmp_path}/corpus"), spark.read.parquet(f"{tmp_path}/asked")
    answers, sent = [], []
    for few in (60, 59):
        monkeypatch.setattr(fetch, "FEW", few, raising=False)
        got = fetch.from_corpus(asked, corpus)
        lines = plan_of(got, capsys).splitlines()
        sent.append([y for x, y in zip(lines, lines[1:]) if "BroadcastExchange" in x])
        answers.append(sorted(map(str, got.collect())))
    assert sent[0] and all("keys=[uri" in x for x in sent[0]) and not sent[1]
    assert answers[0] == answers[1] and len(answers[0]) == 60 and sum("no answer" in x for x in answers[0]) == 20


def test_a_variant_finds_its_address_without_a_look_at_all_lines_behind(spark, capsys):
    lines = [x for k in range(50) for x in (f"#EXT-X-STREAM-INF:BANDWIDTH={k + 1}", "# said between", f"v{k}.m3u8")]
    masters = spark.createDataFrame([(1, "https://h/m.m3u8", "\n".join(["#EXTM3U", *lines, "#EXT-X-STREAM-INF:BANDWIDTH=99"]))], "manifest_id long, url string, body string")
    found = hls.renditions(masters)
    assert {(r["bandwidth"], r["uri"]) for r in found.collect()} == {(k + 1, f"https://h/v{k}.m3u8") for k in range(50)}
    assert "1, unboundedfollowing" not in plan_of(found, capsys)
