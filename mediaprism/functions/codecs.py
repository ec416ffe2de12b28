"""Codec strings and code points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codec string prefixes and the family each names.
VIDEO_FAMILIES = {"avc1": "h264", "avc3": "h264", "hvc1": "hevc", "hev1": "hevc", "av01": "av1", "vp09": "vp9", "vp9": "vp9"}
AUDIO_FAMILIES = {"mp4a": "aac", "ac-3": "ac3", "ec-3": "eac3", "opus": "opus"}


def declared_family(codecs: Column, kind: Column) -> Column:
    """The family of the first codec of the kind; null if none is named."""

    def family(table: dict[str, str]) -> Column:
        names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        found = F.regexp_extract(F.lower(codecs), "(?:^|,)\\s*(" + "|".join(sorted(table, key=len, reverse=True)) + ")", 1)
        return F.element_at(names, found)

    return F.when(kind == "video", family(VIDEO_FAMILIES)).when(kind == "audio", family(AUDIO_FAMILIES))


def _hex(codecs: Column, group: int) -> Column:
    found = F.regexp_extract(F.lower(codecs), "avc[13]\\.([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})", group)
    return F.conv(F.nullif(found, F.lit("")), 16, 10).cast("int")


def avc_profile(codecs: Column) -> Column:
    return _hex(codecs, 1)


def avc_level(codecs: Column) -> Column:
    return _hex(codecs, 3)


def declared_video(codecs: Column) -> Column:
    """profile, level and tier (0 main, 1 high) of the first component that states a profile or a level; a number that is not stated is null, and so is the whole if no component states any.

    Six digits are hexadecimal pairs, profile and level apart from a byte of constraints; an older form has decimal numbers between dots.
    HEVC has a letter before the level, AV1 behind it; VP9 knows no tier.
    """

    def number(c: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")

    def pair(c: Column, pattern: str) -> Column:
        return F.conv(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), 16, 10).cast("int")

    def read(c: Column) -> Column:
        letter = F.regexp_extract(c, r"^(?:h(?:vc|ev)1\.[^.]*\.(?:[^.]+\.)*?(?=[lh])|av01\.[^.]*\.\d+)([lmh])", 1)
        level = r"^h(?:vc|ev)1\.[^.]*\.(?:[^.]+\.)*?[lh](\d+)(?:\.|$)"
        return F.struct(
            F.coalesce(pair(c, r"^avc[13]\.([0-9a-f]{2})[0-9a-f]{4}$"), number(c, r"^avc[13]\.(\d+)\.(?:.*\.)?\d+$"), number(c, r"^h(?:vc|ev)1\.[abc]*(\d+)(?:\.|$)"), number(c, r"^(?:av01|vp09)\.(\d+)\.")).alias("profile"),
            F.coalesce(pair(c, r"^avc[13]\.[0-9a-f]{4}([0-9a-f]{2})$"), number(c, r"^avc[13]\.\d+\.(?:.*\.)?(\d+)$"), number(c, level), number(c, r"^av01\.[^.]*\.(\d+)[mh]?(?:\.|$)"), number(c, r"^vp09\.[^.]*\.(\d+)(?:\.|$)")).alias("level"),
            F.when(letter != "", (letter == "h").cast("int")).alias("tier"),
        )

    return F.get(F.filter(F.transform(F.split(F.lower(codecs), ","), lambda c: read(F.trim(c))), lambda x: x["profile"].isNotNull() | x["level"].isNotNull()), 0)


def aac_object_type(codecs: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(codecs), "mp4a\\.40\\.(\\d+)", 1), F.lit("")).cast("int")


def range_of_transfer(transfer: Column) -> Column:
    """Transfer characteristics to a dynamic range: 16 is PQ, 18 HLG; 0, 2 and 3 say nothing."""
    return F.when(transfer.isin(0, 2, 3), F.lit(None).cast("string")).when(transfer == 16, "PQ").when(transfer == 18, "HLG").when(transfer.isNotNull(), "SDR")
