"""Scalar functions on manifests' texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ATTRIBUTE = r'([A-Za-z0-9-]+)=("[^"]*"|[^,]*)'


def attributes(text: Column) -> Column:
    """An attribute list as a map: names in upper case, quotes protect commas and are dropped, the last of a name wins."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(1)), F.upper)
    values = F.transform(F.regexp_extract_all(text, F.lit(_ATTRIBUTE), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), '^"|"$', ""))
    # Bound as a lambda's variable, what is found is found once, however often it is named below.
    once = lambda x, use: F.get(F.transform(F.array(x), use), 0)
    # Of equal names only the last is kept, so no session setting is needed.
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    as_map = lambda pairs: F.map_from_arrays(F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"]))
    return once(F.arrays_zip(names.alias("k"), values.alias("v")), lambda pairs: once(last(pairs), as_map))


def whole_number(text: Column, pattern: str) -> Column:
    """The group of a pattern as a number, null where it does not match: a cast of the empty string would raise and catch in each row."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def resolution(value: Column) -> Column:
    """``WxH`` as a struct; parts that are no numbers are 0."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(F.lower(value), "x"), F.lit(i)).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("width"), part(2).alias("height"))


def iso_duration(value: Column) -> Column:
    """ISO 8601 durations in seconds by fixed sizes: a year 365 days, a month 30, a week 7."""
    date = F.regexp_extract(value, "^-?P([^T]*)", 1)
    time = F.regexp_extract(value, "T(.*)$", 1)
    of = lambda text, unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    total = of(date, "Y") * 31_536_000 + of(date, "M") * 2_592_000 + of(date, "W") * 604_800 + of(date, "D") * 86_400 + of(time, "H") * 3600 + of(time, "M") * 60 + of(time, "S")
    return F.when(value.rlike("^-?P"), F.when(value.startswith("-"), -total).otherwise(total))


def program_date_time(value: Column) -> Column:
    """Wall-clock stamps in the layouts players accept."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(x)) for x in layouts])


def human_bytes(n: Column) -> Column:
    """By 1024, one decimal above bytes."""
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, u in enumerate(units, 1):
        small = F.format_string(f"%.1f {u}", n / float(1024**i))
        out = out.when(n < 1024 ** (i + 1), small) if i < len(units) else out.otherwise(small)
    return out


def human_bitrate(bps: Column) -> Column:
    return F.when(bps >= 1_000_000, F.format_string("%.2f Mbps", bps / 1e6)).when(bps >= 1000, F.format_string("%.0f kbps", bps / 1e3)).otherwise(F.format_string("%.0f bps", bps.cast("double")))


def human_fps(fps: Column) -> Column:
    """Frames a second with up to three decimals, none where they are zero."""
    return F.concat(F.regexp_replace(F.format_string("%.3f", fps.cast("double")), r"\.?0+$", ""), F.lit(" fps"))


def human_sample_rate(hertz: Column) -> Column:
    return F.concat(F.regexp_replace(F.format_string("%.2f", hertz / 1000.0), r"\.?0+$", ""), F.lit(" kHz"))


def human_channels(n: Column) -> Column:
    return F.when(n == 1, "mono").when(n == 2, "stereo").when(n == 6, "5.1").when(n == 8, "7.1").otherwise(F.format_string("%d ch", n.cast("long")))


def signed_ms(us: Column) -> Column:
    """Microseconds as whole milliseconds with their sign."""
    return F.format_string("%+d ms", F.round(us / 1000).cast("long"))


def plural(n: Column, one: str, more: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(more or one + "s"))


def joined_and(words: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(words)
    return F.when(n < 2, F.array_join(words, "")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(words, F.when(n > 0, n).otherwise(1))))


def counts_text(values: Column) -> Column:
    """How often each value occurs, by value: ``2 x a, 1 x b``."""
    kinds = F.array_sort(F.array_distinct(values))
    return F.array_join(F.transform(kinds, lambda k: F.concat(F.size(F.filter(values, lambda v: v == k)).cast("string"), F.lit(" x "), k)), ", ")


def http_date(value: Column) -> Column:
    """The Date header as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))


def lenient_utc(value: Column) -> Column:
    """A stamp with or without a zone, taken as UTC where it states none."""
    v = F.trim(value)
    zoned = F.when(v.rlike("(Z|[+-]\\d{2}:?\\d{2})$"), v).otherwise(F.concat(v, F.lit("Z")))
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(x)) for x in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX")])


def short_target(url: Column) -> Column:
    """The last two parts of a path, without the query."""
    parts = F.split(F.regexp_replace(url, "[?#].*$", ""), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are taken out; one at the end leaves its folder."""
    parts = F.split(path, "/", -1)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x)))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike("/\\.\\.?(/|$)"), F.concat(kept, F.when(path.rlike("/\\.\\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(base: Column, reference: Column) -> Column:
    """A reference against the URL it stands in, by RFC 3986. Without a base it stays as it is.

    Both are bound by a lambda, so what they are made of stands in the plan once, however often they are used.
    """
    both = F.array(F.struct(F.coalesce(base, F.lit("")).alias("base"), reference.alias("reference")))
    return F.get(F.transform(both, lambda x: _resolved(x["base"], x["reference"])), 0)


def _resolved(base: Column, reference: Column) -> Column:
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_replace(base, "[?#].*$", "")
    folder = F.regexp_extract(F.substr(whole, F.length(origin) + 1), "^(.*/)", 1)
    folder = F.when((folder == "") & (origin != ""), "/").otherwise(folder)
    path, rest = F.regexp_extract(reference, "^([^?#]*)", 1), F.regexp_extract(reference, "^[^?#]*(.*)$", 1)
    return (
        F.when((base == "") | reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference == "", base)
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), reference))
        .when(reference.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(reference.startswith("?"), F.concat(whole, reference))
        .when(reference.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), reference))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def hex_iv(value: Column) -> Column:
    """A 128-bit initialisation vector of 32 hex digits; null if it is none."""
    digits = F.regexp_extract(value, "^0[xX]([0-9a-fA-F]{32})$", 1)
    return F.when(digits != "", F.to_binary(F.nullif(digits, F.lit("")), F.lit("hex")))


def hex_section(value: Column) -> Column:
    """Bytes written in hex after 0x; null if they are not."""
    digits = F.regexp_extract(value, "^0[xX]((?:[0-9a-fA-F]{2})+)$", 1)
    return F.when(digits != "", F.to_binary(F.nullif(digits, F.lit("")), F.lit("hex")))


# Key formats and the system each names.
KEY_FORMATS = {
    "com.apple.streamingkeydelivery": "94ce86fb-07ff-4f43-adb8-93d2fa968ca2",
    "com.microsoft.playready": "9a04f079-9840-4286-ab92-e65be0885f95",
    "com.widevine": "edef8ba9-79d6-4ace-a3c8-27dcd51d21ed",
}


def drm_system(key_format: Column) -> Column:
    """The protection system's UUID that a key format names, by name or as ``urn:uuid:``; null for the plain one and unknown names."""
    names = F.create_map(*[F.lit(x) for kv in KEY_FORMATS.items() for x in kv])
    lower = F.lower(F.trim(key_format))
    return F.when(lower.startswith("urn:uuid:"), F.substr(lower, F.lit(10))).otherwise(F.try_element_at(names, lower))


def header(headers: Column, *names: str) -> Column:
    """The first value of the first header that is there, whatever the case of its name."""
    of = lambda n: F.get(F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == n.lower())), 0), 0)
    return F.coalesce(*[of(n) for n in names])


def sequence_iv(sequence: Column) -> Column:
    """The IV of a segment that states none: its number, big-endian."""
    return F.to_binary(F.lpad(F.hex(sequence.cast("long")), 32, "0"), F.lit("hex"))


def decrypted(body: Column, key: Column, iv: Column) -> Column:
    """AES-128-CBC with PKCS#7 padding; null where key or padding is wrong."""
    return F.try_aes_decrypt(F.concat(iv, body), key, F.lit("CBC"))


def digest(body: Column) -> Column:
    """The first 8 bytes of SHA-256, in hex."""
    return F.left(F.sha2(body, 256), F.lit(16))
