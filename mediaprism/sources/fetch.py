"""Where bodies come from: a corpus table, or HTTP as a Python data source.

Fetched bodies are to be written before anything reads them twice: a live origin may answer
differently each time.
"""

from __future__ import annotations

import http.client
import socket
import ssl
import time
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediaprism.storage import large

SCHEMA = "uri string, range string, status int, content_type string, body binary, truncated boolean, elapsed_us bigint, error string"


#: Ranges that begin in one stretch of so many bytes are cut together.
STRETCH = 16 << 20
#: Of so few requests the addresses are sent to the bodies, so that only bodies asked for are moved.
FEW = 50_000


def byte_range(offset, length):
    """The header of a byte range."""
    return F.when(length.isNotNull(), F.format_string("bytes=%d-%d", offset, offset + length - 1))


def from_corpus(requests: DataFrame, corpus: DataFrame, cap: int = 64 << 20) -> DataFrame:
    """Answers to requests (uri, offset, length; nulls for a whole body; further columns stay) from a table (uri, status, body and, if there, headers).

    A range is cut out of the body and answered by 206. Without an entry the answer is an error; success is 200 or 206;
    longer bodies are cut and marked.
    """
    headers = F.col("headers") if "headers" in corpus.columns else F.lit(None).cast("map<string,array<string>>")
    held = corpus.select("uri", "status", F.col("body").alias("_whole"), headers.alias("headers"))
    ranged, columns = F.col("length").isNotNull(), requests.columns
    if requests.count() <= FEW:
        held = held.join(F.broadcast(requests.select("uri").distinct()), "uri", "left_semi")
    # Requests may carry much, so they never pass the driver: both sides meet by a shuffle.
    found = requests.where(~ranged).join(large(held), "uri", "left").select(*columns, "status", "headers", F.col("_whole").alias("_asked"))
    parts = requests.where(ranged)
    if not parts.isEmpty():
        # All ranges of one stretch of a body are cut while that body is there once.
        stretch = parts.groupBy("uri", F.floor(F.coalesce("offset", F.lit(0)) / STRETCH)).agg(F.collect_list(F.struct(*columns)).alias("_asks")).select("uri", "_asks").join(large(held), "uri", "left")
        cut = lambda r: F.struct(r.alias("r"), F.substr(F.col("_whole"), (F.coalesce(r["offset"], F.lit(0)) + 1).cast("int"), r["length"].cast("int")).alias("_asked"))
        cuts = stretch.select("status", "headers", F.explode(F.transform("_asks", cut)).alias("c"))
        found = found.unionByName(cuts.select("c.r.*", "status", "headers", "c._asked"))
    ok = F.col("status").isin(200, 206)
    return found.select(
        *columns,
        F.when(ranged & (F.col("status") == 200), 206).otherwise(F.col("status")).alias("status"),
        "headers",
        F.expr(f"substring(_asked, 1, {cap})").alias("body"),
        F.coalesce(F.octet_length("_asked") > cap, F.lit(False)).alias("truncated"),
        F.when(F.col("status").isNull(), "no answer").when(~ok, F.concat(F.lit("status "), F.col("status").cast("string"))).alias("error"),
    )


def over_http(requests: DataFrame, *, cap: int = 64 << 20, timeout: float = 15, headers: dict[str, str] | None = None, insecure: bool = False, edges: dict[str, str] | None = None) -> DataFrame:
    """Answers over HTTP to requests (uri, offset, length; further columns stay), read by executors in the rows' own partitions.

    ``edges``: hosts to dial at another address (``host[:port]``), under their own name; a stated port replaces the URL's.
    The result is to be written before anything reads it twice.
    """
    sent = {"User-Agent": "mediaprism", **(headers or {})}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (uri, offset, length) in enumerate(zip(*(b.column(c).to_pylist() for c in ("uri", "offset", "length")), strict=True)):
                span = {} if length is None else {"Range": f"bytes={offset or 0}-{(offset or 0) + length - 1}"}
                a = get(uri, sent | span, cap, timeout, insecure, edges or {})
                answer = pa.RecordBatch.from_pylist([a], schema=_ANSWER)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, *answer.columns], [*b.schema.names, *_ANSWER.names])

    asked = requests.withColumns({c: F.col(c).cast("long") for c in ("offset", "length")})
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(read, kept + ", status int, headers map<string,array<string>>, content_type string, body binary, truncated boolean, elapsed_us long, error string")


_ANSWER = pa.schema([("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.list_(pa.string()))), ("content_type", pa.string()), ("body", pa.binary()), ("truncated", pa.bool_()), ("elapsed_us", pa.int64()), ("error", pa.string())])


def get(uri: str, headers: dict[str, str], cap: int, timeout: float, insecure: bool, edges: dict[str, str]) -> dict:
    """One GET: status, headers, content_type, body up to ``cap``, truncated, elapsed_us, error; an error status keeps its body."""
    began, out = time.monotonic(), {"status": None, "headers": [], "content_type": None, "body": b"", "truncated": False, "error": None}
    try:
        u = urllib.parse.urlsplit(uri)
        edge, _, port = edges.get(u.hostname or "", "").partition(":")
        at = int(port) if port else u.port
        if u.scheme == "https":
            context = ssl._create_unverified_context() if insecure else ssl.create_default_context()
            c = http.client.HTTPSConnection(u.hostname, at, timeout=timeout, context=context)
        else:
            c = http.client.HTTPConnection(u.hostname, at, timeout=timeout)
        if edge:  # another address; name and certificate stay those of the URL
            c._create_connection = lambda address, *rest: socket.create_connection((edge, address[1]), *rest)
        c.request("GET", (u.path or "/") + ("?" + u.query if u.query else ""), headers={"Host": u.netloc.rpartition("@")[2], **headers})
        r = c.getresponse()
        body = r.read(cap + 1)
        by_name: dict[str, list[str]] = {}
        for k, v in r.getheaders():
            by_name.setdefault(k.lower(), []).append(v)
        out |= {"status": r.status, "headers": list(by_name.items()), "content_type": (r.getheader("Content-Type") or "").split(";")[0].strip() or None, "body": body[:cap], "truncated": len(body) > cap, "error": None if r.status in (200, 206) else f"status {r.status}"}
        c.close()
    except (OSError, http.client.HTTPException, ValueError) as e:
        out["error"] = str(e) or type(e).__name__
    return out | {"elapsed_us": int((time.monotonic() - began) * 1e6)}


class _Slice(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uris = [u for u in options.get("uris", "").split() if u]
        self.cap, self.timeout = int(options.get("cap", 64 << 20)), float(options.get("timeout", 15))
        self.insecure = options.get("insecure", "false").lower() == "true"
        self.agent, self.slices = options.get("useragent", "mediaprism"), int(options.get("slices", 8))

    def partitions(self) -> list[InputPartition]:
        return [_Slice(self.uris[i :: self.slices]) for i in range(min(self.slices, len(self.uris)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri in partition.uris:
            a = get(uri, {"User-Agent": self.agent}, self.cap, self.timeout, self.insecure, {})
            yield uri, None, a["status"], a["content_type"], a["body"], a["truncated"], a["elapsed_us"], a["error"]


class HttpSource(DataSource):
    """``spark.dataSource.register(HttpSource)``, then ``format("http_bodies").option("uris", "...")``."""

    @classmethod
    def name(cls) -> str:
        return "http_bodies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)
