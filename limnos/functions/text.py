"""String functions as columns; the few that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Spellings of ä ö ü ß in ASCII, fixed values.
TRANSLITERATION = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
#: Accented Latin letters and their base letters, fixed values.
ACCENTED = "àáâãåçèéêëìíîïñòóôõùúûýÿ"
UNACCENTED = "aaaaaceeeeiiiinoooouuuyy"
#: Words of station names that identify nothing, fixed values.
GENERIC_WORDS = ("an", "am", "auf", "bei", "bruecke", "der", "die", "im", "in", "messstelle", "ms", "pegel", "station", "und", "von", "wehr", "zur")


def clean_text(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def key_text(c: Column) -> Column:
    """As clean_text, less a `.0` that type inference appended to a whole number."""
    return F.regexp_replace(clean_text(c), r"^(-?\d+)\.0$", "$1")


def collapse_norm(c: Column) -> Column:
    """Lower case, ß as ss, single blanks, outer punctuation off."""
    return F.btrim(F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("ß"), F.lit("ss")), r"\s+", " "), F.lit(" .,;:"))


def plain_norm(c: Column) -> Column:
    """Lower case, ß as ss, Latin letters without accents, single blanks."""
    v = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.translate(v, ACCENTED + "äöü", UNACCENTED + "aou"), r"\s+", " "))


def ascii_tokens(c: Column) -> Column:
    """Name in ASCII tokens joined by blanks: quotes off, lower case, umlauts spelled out, accents off."""
    v = F.lower(F.trim(F.btrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("'"))))
    for letter, spelled in TRANSLITERATION.items():
        v = F.replace(v, F.lit(letter), F.lit(spelled))
    v = F.translate(v, ACCENTED, UNACCENTED)
    return F.trim(F.regexp_replace(v, "[^a-z0-9]+", " "))


@pandas_udf(StringType())
def ascii_tokens_full(s: pd.Series) -> pd.Series:
    """ascii_tokens with full Unicode decomposition, for names beyond Latin."""
    table = str.maketrans(TRANSLITERATION)

    def one(v):
        v = unicodedata.normalize("NFKD", (v or "").strip().strip("'").strip().casefold().translate(table))
        return " ".join(re.findall("[a-z0-9]+", "".join(c for c in v if not unicodedata.combining(c))))

    return s.map(one)


@pandas_udf(StringType())
def compatibility_fold(s: pd.Series) -> pd.Series:
    """NFKC, case folded, single blanks."""
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


@pandas_udf(StringType())
def accent_fold(s: pd.Series) -> pd.Series:
    """Case folded without combining marks."""
    return s.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c)))


def informative_tokens(c: Column) -> Column:
    words = F.array_distinct(F.split(ascii_tokens(c), " "))
    return F.filter(F.array_except(words, F.array(*map(F.lit, GENERIC_WORDS))), lambda w: F.length(w) > 1)


def token_set_score(a: Column, b: Column) -> Column:
    """100 * 2 * shared / (tokens of either), 0 if a side has none."""
    x, y = informative_tokens(a), informative_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.lit(200.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def name_variants(c: Column) -> Column:
    """The name, the name without its parentheses, and what each pair of parentheses holds."""
    inner = F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1))
    every = F.concat(F.array(c, F.regexp_replace(c, r"\([^)]*\)", " ")), inner)
    return F.array_distinct(F.filter(every, lambda v: ascii_tokens(v) != ""))


def waterbody_core(c: Column) -> Column:
    """What follows the last underscore."""
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), "_"), -1))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def short_code(c: Column) -> Column:
    """Official lake code inside a longer identifier, or null."""
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"([A-Z0-9]+OW\d+-\d+)", 1), F.lit(""))


def code_norm(c: Column, scheme: str = "eu") -> Column:
    """Upper case; drainage codes lose dots and blanks."""
    v = F.upper(F.trim(c))
    return F.regexp_replace(v, r"[.\s]", "") if scheme == "gkz" else v


def quote_norm(c: Column) -> Column:
    """Joins words hyphenated at line ends, drops soft hyphens, single blanks."""
    v = F.regexp_replace(F.replace(c, F.lit("­"), F.lit("")), r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def has_term(text: Column, term: str) -> Column:
    """The term between word boundaries, letters of any script counting as word characters."""
    return text.rlike(r"(?U)(?<!\w)" + re.escape(term) + r"(?!\w)")


def matched_terms(text: Column, terms: list[str]) -> Column:
    v = collapse_norm(text)
    return F.array_compact(F.array(*(F.when(has_term(v, t.lower()), F.lit(t)) for t in terms))) if terms else F.expr("cast(array() as array<string>)")


def _named(name: str):
    return lambda w: F.struct(F.lit(name).alias("name"), w.alias("window"))


def identity_spans(text: Column, names: list[str], exclusions: list[str] = (), reach: int = 250) -> Column:
    """Array of (name, window): surroundings of each bounded name, after blanking more specific competing names."""
    v = F.replace(collapse_norm(text), F.lit("-"), F.lit(""))
    for other in exclusions:
        other = other.lower().replace("-", "")
        v = F.regexp_replace(v, r"(?U)(?<!\w)" + re.escape(other) + r"(?!\w)", " " * len(other))
    found = []
    for name in names:
        found.append(F.transform(_windows(v, name.lower().replace("-", ""), reach), _named(name)))
    return F.concat(*found)


def _windows(v: Column, term: str, reach: int) -> Column:
    r"""What ``(?Us).{0,reach}(?<!\w)term(?!\w).{0,reach}`` finds one after another, in one pass.

    The text is split where the term begins; a fold over the parts opens a window at the first place
    not yet used, moves its term on as far as ``reach`` allows, and closes it.
    """
    quoted = re.escape(term)
    if not term:
        return F.regexp_extract_all(v, F.lit(rf"(?Us)(.{{0,{reach}}}(?<!\w)(?!\w).{{0,{reach}}})"), F.lit(1))
    end = lambda w: w["name"] + len(term) + reach
    span = lambda w: F.array(F.struct(w["start"].alias("start"), end(w).alias("end")))

    def moved(w: Column, part: Column) -> Column:
        at = w["at"]
        named, open_ = (at > 0) | w["leads"], w["start"] >= 0
        keeps = named & open_ & (at <= w["start"] + reach)
        closes = named & open_ & (at > w["start"] + reach)
        used = F.when(closes, end(w)).otherwise(w["used"])
        opens = named & ~keeps & (at >= used)
        start = F.when(~named | keeps, w["start"]).when(opens, F.greatest(used, at - reach)).otherwise(-1)
        return F.struct((at + F.length(part)).alias("at"), w["leads"].alias("leads"), used.alias("used"), start.alias("start"), F.when(keeps | opens, at).otherwise(w["name"]).alias("name"), F.when(closes, F.concat(w["out"], span(w))).otherwise(w["out"]).alias("out"))

    def spans(u: Column) -> Column:
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        first = F.struct(F.lit(0).alias("at"), F.coalesce(F.regexp_like(u, F.lit(rf"(?U)^{quoted}(?!\w)")), F.lit(False)).alias("leads"), F.lit(0).alias("used"), F.lit(-1).alias("start"), F.lit(0).alias("name"), none.alias("out"))
        parts = F.split(u, rf"(?U)(?={quoted}(?!\w))(?<!\w)", -1)
        found = F.aggregate(parts, first, moved, lambda w: F.when(w["start"] >= 0, F.concat(w["out"], span(w))).otherwise(w["out"]))
        return F.when(F.contains(u, F.lit(term)), F.transform(found, lambda s: F.substr(u, s["start"] + 1, s["end"] - s["start"]))).when(u.isNotNull(), F.array().cast("array<string>"))

    return F.get(F.transform(F.array(v), spans), 0)


def clip(c: Column, n: int) -> Column:
    return F.substr(F.coalesce(c, F.lit("")), F.lit(1), F.lit(n))


def composite_key(*parts: Column) -> Column:
    """Length-prefixed parts joined by `|`, so that no two tuples share a key."""
    return F.concat_ws("|", *(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*(p.alias(f"c{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def label_tag(label: Column, position: Column) -> Column:
    """First three letters in upper case, or S and the position."""
    letters = F.upper(F.substr(F.regexp_replace(label, "[^A-Za-z]", ""), F.lit(1), F.lit(3)))
    return F.when(letters == "", F.concat(F.lit("S"), position.cast("string"))).otherwise(letters)


def german_number(c: Column, places: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, places), ",.", ".,")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def option_count(label: Column) -> Column:
    """The count in a label such as `Elbe --- (1.234 values)`."""
    return F.try_to_number(F.replace(F.regexp_extract(label, r"---\s*\(([\d.]+)", 1), F.lit("."), F.lit("")), F.lit("999999999999")).cast("long")


@pandas_udf(DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x and y else 0.0 for x, y in zip(a, b)])


#: Texts that are split at once.
TEXTS = 64


@arrow_udf(ArrayType(StringType()))
def split_near(texts: pa.Array, limits: pa.Array) -> pa.Array:
    """Pieces of at most `limit` characters, cut at the last line feed, else the last blank, else hard.

    Only TEXTS texts and their pieces are Python objects at a time, all others stay in Arrow's buffers.
    """

    def one(text, limit):
        out, text = [], (text or "").strip()
        while len(text) > limit:
            at = max(text.rfind("\n", 1, limit + 1), 0) or max(text.rfind(" ", 1, limit + 1), 0) or limit
            out.append(text[:at].strip())
            text = text[at:].strip()
        return [p for p in [*out, text] if p]

    kind = pa.list_(pa.string())
    few = lambda k: zip(texts.slice(k, TEXTS).to_pylist(), limits.slice(k, TEXTS).to_pylist())
    return pa.concat_arrays([pa.array([one(t, int(n)) for t, n in few(k)], kind) for k in range(0, len(texts), TEXTS)] or [pa.array([], kind)])
