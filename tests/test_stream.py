"""From manifests and bytes to findings, against SQL that states what was planted."""

import http.server
import threading

from conftest import SF, rows_of
from pyspark.sql import functions as F

from mediaprism.plans import stream, synthetic
from mediaprism.queries import QUERIES, SQL
from mediaprism.sources import fetch


def test_report_of_made_streams_agrees_with_sql(spark, duck):
    got = QUERIES["stream_report"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.execute(SQL["stream_report"]).df())
    assert {"gap", "overlap", "counter", "unparseable", "differs", "none", "late", "drift", "nothing-changes", "over-target"} <= set(got["rule"])


def test_sampling(spark):
    r = spark.createDataFrame([(0, i, "video", b) for i, b in enumerate((500, 100, 300, 200, 400))] + [(0, 9, "audio", 1)], "manifest_id long, n int, kind string, bandwidth long")
    pick = lambda k: sorted(x["bandwidth"] for x in stream.evenly(r, k).where("kind = 'video'").collect())
    assert pick(1) == [500] and pick(2) == [100, 500] and pick(3) == [100, 300, 500] and pick(9) == [100, 200, 300, 400, 500] and stream.evenly(r, 1).count() == 2
    s = spark.createDataFrame([(u, q, u == 1) for u in (0, 1) for q in range(5)], "rendition long, sequence long, live boolean")
    got = lambda *a: sorted((x["rendition"], x["sequence"]) for x in stream.first_or_last(s, 2, *a).collect())
    assert got() == [(0, 0), (0, 1), (1, 3), (1, 4)] and got("edge") == [(0, 3), (0, 4), (1, 3), (1, 4)]
    assert sorted(x["sequence"] for x in stream.newest_with_parts(s.where("rendition = 0").withColumn("idx", F.lit(0)), 2).collect()) == [3, 4]


def test_an_encrypted_segment_is_opened_and_a_wrong_key_told(spark):
    plain = synthetic.segment(900_000, 320, 176, 0, None)
    key, iv = bytes(range(16)), (7).to_bytes(16, "big")
    sealed = spark.createDataFrame([(bytearray(plain),)], "b binary").select(F.expr(f"substring(aes_encrypt(b, X'{key.hex()}', 'CBC', 'PKCS', X'{iv.hex()}'), 17)")).first()[0]
    lists = "#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:7\n#EXT-X-KEY:METHOD=AES-128,URI=\"{}\"\n#EXTINF:2.0,\n#EXT-X-BYTERANGE:{}@5\nall.ts\n#EXT-X-ENDLIST"
    bodies = [("https://h/a.m3u8", lists.format("good", len(sealed)).encode()), ("https://h/b.m3u8", lists.format("bad", len(sealed)).encode()), ("https://h/all.ts", b"-----" + bytes(sealed) + b"---"), ("https://h/good", key), ("https://h/bad", bytes(16))]
    corpus = spark.createDataFrame([(u, 200, bytearray(b)) for u, b in bodies], "uri string, status int, body binary")
    master = spark.createDataFrame([(0, "https://h/m.m3u8", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=9\na.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=8\nb.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=7\nc.m3u8")], "manifest_id long, url string, body string")
    rel = stream.from_stream(master, corpus)
    s = {r["rendition"]: r for r in rel.all_segments.collect()}
    assert s[1]["decrypted"] and s[1]["parsed"] and (s[1]["min_pts"], s[1]["width"], s[1]["measured_us"]) == (900_000, 320, 2_000_000)
    assert s[2]["decrypt_failed"] and not s[2]["parsed"] and [r["failed"] for r in rel.all_renditions.orderBy("rendition").collect()] == [False, False, True]


def test_http_ranges_headers_and_edges(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"0123456789"
            span = self.headers.get("Range")
            a, b = map(int, span[6:].split("-")) if span else (0, 9)
            self.send_response(404 if self.path == "/none" else 206 if span else 200)
            for k, v in (("Content-Type", "video/mp2t; x=1"), ("X-Host", self.headers["Host"]), ("X-Sent", self.headers.get("X-Token", ""))):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body[a : b + 1])

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    rows = [(f"http://cdn.invalid:{port}/a", 2, 3), (f"http://cdn.invalid:{port}/none", None, None), ("http://127.0.0.1:1/x", None, None)]
    got = {r["uri"]: r for r in fetch.over_http(spark.createDataFrame(rows, "uri string, offset long, length long"), cap=8, timeout=5, headers={"X-Token": "t"}, edges={"cdn.invalid": "127.0.0.1"}).collect()}
    a, missing, dead = (got[u] for u, _, _ in rows)
    assert (a["status"], bytes(a["body"]), a["content_type"], a["headers"]["x-host"], a["headers"]["x-sent"]) == (206, b"234", "video/mp2t", [f"cdn.invalid:{port}"], ["t"])
    assert missing["status"] == 404 and missing["error"] == "status 404" and missing["truncated"] and len(missing["body"]) == 8 and dead["status"] is None and dead["error"]
    server.shutdown()
