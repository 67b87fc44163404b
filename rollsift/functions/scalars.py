"""Text, formatting, JSON and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_content(text) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def capitalise(text) -> Column:
    """First letter in upper case, the rest unchanged."""
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def remove_prefix(text, prefix: str) -> Column:
    t = _c(text)
    return F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t))).otherwise(t)


def remove_suffix(text, suffix: str) -> Column:
    t = _c(text)
    return F.when(t.endswith(suffix), F.substring(t, F.lit(1), F.length(t) - len(suffix))).otherwise(t)


def base_environment(env_id) -> Column:
    """The part of an environment id before its version."""
    return F.element_at(F.split(_c(env_id), "@"), 1)


def short_name(text, stop_words: list[str]) -> Column:
    """Words that aren't stop words, joined by one space."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_join(F.filter(F.split(_c(text), r"\s+"), lambda w: ~F.array_contains(stop, w)), " ")


def strip_ansi(text) -> Column:
    return F.regexp_replace(_c(text), "\x1b\\[[0-9;]*[A-Za-z]", "")


def composite_key(*columns) -> Column:
    return F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns])


def format_number(x) -> Column:
    """1234 as 1.23K, and so with M and B; under 1000 with two digits; null stays null."""
    v = _c(x).cast("double")
    a = F.abs(v)
    scaled = lambda by, unit: F.concat(F.format_string("%.2f", v / by), F.lit(unit))
    return F.when(v.isNull(), F.lit(None)).when(a < 1e3, F.format_string("%.2f", v)).when(a < 1e6, scaled(1e3, "K")).when(a < 1e9, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))


def format_seconds(x) -> Column:
    """The two largest units of a duration; milliseconds under a second; null stays null."""
    s = _c(x).cast("double")
    whole = F.floor(s).cast("long")
    part = lambda div, mod, unit: F.concat((F.floor(whole / div) % mod).cast("string"), F.lit(unit))
    days = F.concat(F.floor(whole / 86400).cast("string"), F.lit("d "), part(3600, 24, "h"))
    hours = F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), part(60, 60, "m"))
    minutes = F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), part(1, 60, "s"))
    return F.when(s.isNull(), F.lit(None)).when(s >= 86400, days).when(s >= 3600, hours).when(s >= 60, minutes).when(s >= 1, F.format_string("%.2fs", s)).otherwise(F.format_string("%.0fms", s * 1000))


def json_text(column, kind: T.DataType | None = None) -> Column:
    """Text passes through, null is empty, anything else becomes JSON."""
    c = _c(column)
    return F.coalesce(c if isinstance(kind, T.StringType) else F.to_json(c), F.lit(""))


def finite_or_null(x) -> Column:
    v = _c(x)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def content_hash(text) -> Column:
    """First 16 hex digits of sha-256."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def suffix_value(mapping, suffix: str) -> Column:
    """Value of the first key that ends with the suffix; null if there is none."""
    return F.try_element_at(F.map_values(F.map_filter(_c(mapping), lambda k, _: k.endswith(suffix))), F.lit(1))


def merged(left, right) -> Column:
    """Maps merged; the right one's values win."""
    l, r = _c(left), _c(right)
    kept = F.map_filter(l, lambda k, _: ~F.array_contains(F.map_keys(r), k))
    return F.map_concat(kept, r)


def problem_id(example_id, sample_id) -> Column:
    """The example id as a number, else the sample id."""
    return F.coalesce(F.expr(f"try_cast({example_id} as bigint)") if isinstance(example_id, str) else example_id.try_cast("bigint"), _c(sample_id))


def training_label(kind, lora_rank) -> Column:
    """Label of a training type: its name, with the adapter's rank if it has one."""
    return F.when(_c(lora_rank).isNull(), F.concat(F.upper(_c(kind)), F.lit(" Full"))).otherwise(F.concat(F.upper(_c(kind)), F.lit(" LoRA(r="), _c(lora_rank).cast("string"), F.lit(")")))


def utc_stamp(epoch_seconds) -> Column:
    """Seconds since 1970 as UTC text with a Z, whatever the session's time zone."""
    at = F.timestamp_seconds(_c(epoch_seconds).cast("long"))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Bits of ``hash_number``.
HASH_BITS = 60


def hash_number(*key: Column, seed: int = 0) -> Column:
    """A whole number of 60 bits from the key's values, the same in any engine: the first 15 digits of the MD5 of
    ``seed:value:value``. A null value counts as no text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
