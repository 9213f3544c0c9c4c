"""Numbers, booleans, dates, arrays and maps as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_CODES = ("y", "yes", "ja", "true", "1")
FALSE_CODES = ("n", "no", "nein", "false", "0")
MISSING = ("", "nan", "none", "null", "-", "---")
NO_RESULT = 999


def number(c: Column) -> Column:
    """Double, null where it is none or not finite."""
    v = c.cast("string").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def integer(c: Column) -> Column:
    """Whole part of a number."""
    return number(c).cast("long")


def tri_state(c: Column) -> Column:
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin(*TRUE_CODES), True).when(v.isin(*FALSE_CODES), False)


def missing_to_null(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def qualified(c: Column, note: Column | None = None) -> Column:
    """(qualifier, value) of text such as `< 0,05`; a note on the limit of determination makes it `<`."""
    text = F.trim(F.coalesce(c, F.lit("")))
    sign = F.nullif(F.regexp_extract(text, r"^(<=|>=|[<>≤≥~])", 1), F.lit(""))
    plain = F.replace(F.trim(F.regexp_replace(text, r"^(<=|>=|[<>≤≥~])", "")), F.lit(","), F.lit("."))
    if note is not None:
        sign = F.when(F.lower(F.coalesce(note, F.lit(""))).contains("kleiner bestimmungsgrenze"), "<").otherwise(sign)
    return F.struct(sign.alias("qualifier"), number(plain).alias("value"))


def grouped_number(c: Column) -> Column:
    """Strict German number: `1.234,5` or `1234,5`; anything else is null."""
    ok = F.trim(c).rlike(r"^[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$")
    return F.when(ok, F.replace(F.replace(F.trim(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))


def quantity(c: Column) -> Column:
    """(operator, value, unit) of text such as `<= 1.234,5 mg/l`."""
    pattern = r"^\s*(<=|>=|[<>≤≥~=])?\s*([+-]?[\d.]*\d(?:,\d+)?)\s*(.*?)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return F.struct(part(1).alias("operator"), grouped_number(part(2)).alias("value"), part(3).alias("unit"))


def dbf_number(c: Column) -> Column:
    """(value, literal, issue) of a dBASE numeric field; malformed literals are kept, not lost."""
    text = F.trim(F.regexp_replace(c, r"\x00", " "))
    good = text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(good, number(text))
    issue = F.when(text == "", None).when(text.rlike(r"^\*+$"), "overflow").when(~good, "malformed").when(value.isNull(), "not finite")
    return F.struct(value.alias("value"), text.alias("literal"), issue.alias("issue"))


def validity(c: Column, least: float = 1, most: float = 5, sentinel: float = NO_RESULT) -> Column:
    """(value, valid, reason): missing and sentinel values are invalid, others must lie in range."""
    v = number(c)
    reason = F.when(v.isNull(), "missing").when(v == sentinel, "sentinel").when(~v.between(least, most), "out of scale")
    return F.struct(F.when(reason.isNull(), v).alias("value"), reason.isNull().alias("valid"), reason.alias("reason"))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def hectares_to_km2(c: Column) -> Column:
    return c / 100.0


def m2_to_km2(c: Column) -> Column:
    return c / 1_000_000.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def token_estimate(c: Column) -> Column:
    """A third of the bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 3).cast("long")


def backoff_seconds(attempt: Column, cap: float = 60.0) -> Column:
    return F.least(F.lit(cap), F.pow(F.lit(2.0), attempt))


def limit_row(parameter: Column) -> Column:
    """(statistic, time basis, kind) that a limit's wording states."""
    p = F.lower(F.coalesce(parameter, F.lit("")))
    statistic = F.when(p.rlike("maxim|höchst|max\\."), "maximum").when(p.rlike("mittel|durchschnitt"), "mean").when(p.rlike("minim|mindest"), "minimum")
    basis = F.when(p.rlike("sekunde|/s\\b"), "second").when(p.rlike("stunde|/h\\b"), "hour").when(p.rlike("tag|/d\\b"), "day").when(p.rlike("monat"), "month").when(p.rlike("jahr|/a\\b"), "year")
    kind = F.when(p.rlike("konzentration|mg/l|µg/l"), "concentration").when(p.rlike("menge|abfluss|m³"), "quantity")
    return F.struct(statistic.alias("statistic"), basis.alias("time_basis"), kind.alias("kind"))


#: Time formats that sources use, fixed values.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy")


def timestamp_of(c: Column, formats: tuple[str, ...] = TIME_FORMATS) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats))


def date_of(c: Column) -> Column:
    return timestamp_of(c).cast("date")


def german_date(c: Column) -> Column:
    """dd.MM.yyyy as ISO text."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit("dd.MM.yyyy")), "yyyy-MM-dd")


def partial_date_valid(c: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD that exists."""
    full = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    return F.coalesce(F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def interval_reversed(start: Column, end: Column) -> Column:
    """Both valid, and the start after the end at the precision they share."""
    n = F.least(F.length(start), F.length(end))
    return F.coalesce(partial_date_valid(start) & partial_date_valid(end) & (F.substr(start, F.lit(1), n) > F.substr(end, F.lit(1), n)), F.lit(False))


def historical_path(path: Column) -> Column:
    """A folder of the path is a year of this century."""
    return F.exists(F.slice(F.split(path, "/"), 1, 1000), lambda p: p.rlike(r"^20\d{2}$"))


def reference_date(text: Column) -> Column:
    """Date stated after `Stand`."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(?i)stand[^0-9]{0,20}(\d{2}\.\d{2}\.\d{4})", 1), F.lit("dd.MM.yyyy")).cast("date")


def split_set(c: Column, sep: str = "|") -> Column:
    """Sorted distinct non-empty members."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.coalesce(c, F.lit("")), "\\" + sep), "")))


def join_set(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), sep)


def first_present(c: Column) -> Column:
    return F.get(F.filter(c, lambda x: x.isNotNull()), 0)


def present(c: Column, kind: str = "string") -> Column:
    return c.isNotNull() & ((F.size(c) > 0) if kind in ("array", "map") else (c.cast("string") != ""))


def clean_properties(c: Column) -> Column:
    """String map without null values."""
    return F.map_filter(c, lambda _, v: v.isNotNull())


def merged_config(defaults: Column, own: Column) -> Column:
    """Own entries over the defaults."""
    kept = F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    return F.map_concat(kept, own)


def last_by_key(entries: Column) -> Column:
    """Map of (key, value) entries; of one key the last stays."""
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(last)


def canonical_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' texts; nulls differ from empty texts."""
    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\u0001"), b), [F.coalesce(c.cast("string"), F.lit("\u0002")) for c in columns]), 256)


def json_value(c: Column, kind: str) -> Column:
    """A value as JSON text can hold it, for a column of type ``kind``: dates and times in ISO form, what JSON has no type for as its text; arrays and maps by their members."""
    if kind.startswith("timestamp"):
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if kind.startswith("array<"):
        return F.transform(c, lambda x: json_value(x, kind[6:-1]))
    if kind.startswith("map<string,"):
        return F.transform_values(c, lambda _, x: json_value(x, kind[11:-1]))
    plain = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return c if kind in plain or kind.startswith("struct<") else c.cast("string")


def json_rows(df: DataFrame) -> DataFrame:
    """(json): every row as an object, nulls kept."""
    return df.select(F.to_json(F.struct(*(json_value(F.col(f"`{name}`"), kind).alias(name) for name, kind in df.dtypes)), {"ignoreNullFields": "false"}).alias("json"))


def csv_guard(c: Column) -> Column:
    """Cells that a spreadsheet would run as formulas get a leading apostrophe."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
