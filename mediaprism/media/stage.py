"""The Arrow stage: bodies in, one row per track out. To be written before checks read it, without the bodies."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaprism.media.containers import parse
from mediaprism.media.splices import splice

FIELDS = {
    "kind": "string", "codec": "string", "timescale": "long", "min_pts": "long", "max_pts": "long", "samples": "long", "stated_dur": "long", "frame_dur": "long", "width": "long", "height": "long",
    "sample_rate": "long", "channels": "long", "cc_errors": "long", "opens_on_keyframe": "boolean", "has_keyframe": "boolean", "protection": "string",
    "profile": "long", "level": "long", "tier": "long", "constraints": "long", "primaries": "long", "transfer": "long", "matrix": "long", "full_range": "boolean", "object_type": "long", "sbr": "boolean", "ps": "boolean",
    "captions": "strings", "clear_samples": "long", "encrypted_samples": "long", "leading_clear_samples": "long", "crypt_pattern": "boolean",
}
SPLICE = {"command": "string", "pts": "long", "timescale": "long", "event_id": "long", "out_of_network": "boolean", "duration": "long", "segmentation_type": "long", "upid": "string"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "strings": pa.list_(pa.string())}
_SQL = {"string": "string", "long": "bigint", "boolean": "boolean", "strings": "array<string>"}
_TRACK, _SPLICE, _CUE = (pa.struct([(k, _ARROW[v]) for k, v in f.items()]) for f in (FIELDS, SPLICE, {"begin_ms": "long", "end_ms": "long"}))


def media(bodies: DataFrame) -> DataFrame:
    """Of each body (uri, body, init; more columns stay) container (null: not recognised), supported (false: known, but of a kind that is not read), sealed (its samples are encrypted inside the stream), bytes, tracks, splices, drm, cues, map (the clock a subtitle file states).

    The key of a body is every column but ``body`` and ``init``.
    """
    keys = [c for c in bodies.columns if c not in ("body", "init")]
    struct = lambda fields: "struct<" + ",".join(f"{k}:{_SQL[v]}" for k, v in fields.items()) + ">"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bodies.select(*keys).schema)
    schema = f"{kept}, container string, supported boolean, sealed boolean, bytes long, tracks array<{struct(FIELDS)}>, splices array<{struct(SPLICE)}>, drm array<string>, cues array<struct<begin_ms:bigint,end_ms:bigint>>, map long"
    names = [*keys, "container", "supported", "sealed", "bytes", "tracks", "splices", "drm", "cues", "map"]

    def run(batches):
        for b in batches:
            out = []
            for x, i in zip(b.column(len(keys)), b.column(len(keys) + 1), strict=True):
                raw = x.as_py() or b""
                f = parse(raw, i.as_py()) or {}
                tracks = [{k: t.get(k) for k in FIELDS} for t in f.get("tracks", [])]
                splices = [{k: t.get(k) for k in SPLICE} for t in f.get("splices", [])]
                cues = [{"begin_ms": a, "end_ms": z} for a, z in f.get("cues", [])]
                out.append((f.get("container"), not f.get("unsupported", False), bool(f.get("sealed", False)), len(raw), tracks, splices, f.get("drm", []), cues, f.get("map")))
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(_TRACK), pa.list_(_SPLICE), pa.list_(pa.string()), pa.list_(_CUE), pa.int64()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array([o[j] for o in out], k) for j, k in enumerate(kinds))], names)

    return bodies.select(*keys, "body", "init").mapInArrow(run, schema)


@F.pandas_udf(T.StructType([T.StructField("event", T.LongType()), T.StructField("pts", T.LongType())]))
def section_told(sections: pd.Series) -> pd.DataFrame:
    """Event and clock (90,000 ticks a second) of splice sections that a manifest carries; nulls where one is damaged or states none."""
    told = [(s is not None and splice(bytes(s))) or {} for s in sections]
    return pd.DataFrame({"event": pd.array([t.get("event_id") for t in told], dtype="Int64"), "pts": pd.array([t.get("pts") for t in told], dtype="Int64")})


def tracks(parsed: DataFrame) -> DataFrame:
    """One row per track, in container order."""
    return parsed.select("uri", "container", F.posexplode("tracks").alias("track_ordinal", "t")).select("uri", "container", "track_ordinal", "t.*")


def timeline(tracks_: DataFrame) -> DataFrame:
    """The track that carries a segment's time: the first video with a clock, else audio, else any."""
    rank = F.when(F.col("kind") == "video", 0).when(F.col("kind") == "audio", 1).otherwise(2)
    return tracks_.where("min_pts IS NOT NULL").groupBy("uri").agg(F.min_by(F.struct("kind", "timescale", "min_pts", "max_pts", "stated_dur", "frame_dur"), F.struct(rank, "track_ordinal")).alias("t")).select("uri", "t.*")
