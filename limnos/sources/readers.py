"""Readers: delimited text in its dialects, dBASE, shapefiles, JSON, GeoJSON, HTML, file inventories.

Everything lands as strings with file and row provenance; typing is a later step.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from limnos.functions.text import collapse_norm

DELIMITERS = (";", ",", "\t")


def column_name(name: str) -> str:
    """Case-folded, other characters as `_`, at most 63 characters, never starting with a digit."""
    n = re.sub(r"[^0-9a-z]+", "_", name.casefold()).strip("_")[:63]
    return "source_index" if not n else f"column_{n}"[:63] if n[0].isdigit() else n


def column_names(names: list[str]) -> list[str]:
    """Normalised names, repeats numbered from 2."""
    out: list[str] = []
    for n in map(column_name, names):
        unique, k = n, 2
        while unique in out:
            unique, k = f"{n[: 62 - len(str(k))]}_{k}", k + 1
        out.append(unique)
    return out


def long_names(short: list[str], dictionary: list[str]) -> dict[str, str | None]:
    """Long names for column names cut to ten characters: the one entry that begins so, else none."""
    return {s: (hits[0] if len(hits := [d for d in dictionary if d.casefold().startswith(s.casefold())]) == 1 else None) for s in short}


def landed(df: DataFrame, name: str) -> DataFrame:
    """Normalised column names and provenance: source_file and source_row_number (from 1, dense)."""
    return df.toDF(*column_names(df.columns)).withColumn("source_file", F.lit(name))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


#: What windows-1252 has where latin-1 has control characters.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 with or without a mark, else windows-1252, never with replacements for valid text."""
    utf8 = F.regexp_replace(F.decode(content, "utf-8"), "^﻿", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.translate(F.decode(content, "iso-8859-1"), _CONTROLS, _WINDOWS))


def choose_delimiter(header: str) -> str:
    """The delimiter that cuts the header into most fields; a tie is an error."""
    counts = sorted(((len(header.split(d)), d) for d in DELIMITERS), reverse=True)
    if counts[0][0] == 1 or counts[0][0] == counts[1][0]:
        raise ValueError(f"the delimiter of {header[:80]!r} is not clear")
    return counts[0][1]


def read_csv(spark: SparkSession, path: str, sep: str | None = None, quote: str = '"', encoding: str = "UTF-8", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): all columns as strings; rows of another width are issues, or an error if strict."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path} is empty")
    first = header.value.lstrip("﻿")
    sep = sep or choose_delimiter(first)
    names = column_names([c.strip().strip(quote) for c in first.split(sep)])
    schema = StructType([StructField(n, StringType()) for n in [*names, "_corrupt"]])
    rows = spark.read.csv(path, sep=sep, quote=quote, header=True, encoding=encoding, schema=schema, mode="FAILFAST" if strict else "PERMISSIVE", columnNameOfCorruptRecord="_corrupt", enforceSchema=True, multiLine=False)
    # the record column is only filled when all data columns are read with it, whatever is selected later
    rows = rows.where(F.length(F.concat_ws("", *names)) >= 0).withColumn("source_file", F.input_file_name()).withColumn("_data", F.struct(*names))
    issues = rows.where("_corrupt is not null").select("source_file", F.col("_corrupt").alias("line"), F.lit("width").alias("issue"), F.to_json("_data").alias("read_as"))
    return rows.where("_corrupt is null").drop("_corrupt", "_data"), issues


@pandas_udf(ArrayType(StructType([StructField("row", ArrayType(StringType())), StructField("issue", StringType())])))
def parse_portal(texts: pd.Series) -> pd.Series:
    """Rows of the portal dialect: `;` between cells, quote `'`, inner apostrophes literal unless a delimiter or line end follows."""

    def one(text: str | None):
        out = []
        cells: list[str] = []
        cell, quoted, at, fresh = "", False, 0, True
        text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        while at < len(text):
            c = text[at]
            after = text[at + 1] if at + 1 < len(text) else "\n"
            if fresh and c == "'":
                quoted, fresh = True, False
            elif quoted and c == "'" and after in ";\n":
                quoted = False
            elif not quoted and c in ";\n":
                cells.append(cell)
                cell, fresh = "", True
                if c == "\n":
                    if cells != [""]:
                        out.append({"row": cells, "issue": None})
                    cells = []
            else:
                cell, fresh = cell + c, False
            at += 1
        if cell or cells:
            out.append({"row": [*cells, cell], "issue": "unclosed quote" if quoted else None})
        width = len(out[0]["row"]) if out else 0
        return [r if len(r["row"]) == width or r["issue"] else {"row": r["row"], "issue": "width"} for r in out]

    return texts.map(one)


def inspect_csv(files: DataFrame, widths: list[int], sep: str = ";") -> DataFrame:
    """Per file of ``files(path, content)``: html, rows, odd widths, bytes, sha256."""
    text = decoded(F.col("content"))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x != "")
    odd = F.size(F.filter(lines, lambda x: ~F.size(F.split(x, sep)).isin(*widths)))
    return files.select("path", F.lower(F.left(F.ltrim(text), F.lit(200))).rlike("<(!doctype|html)").alias("html"), (F.size(lines) - 1).alias("rows"), odd.alias("odd_widths"), F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unquote_line(line: Column, sep: str) -> Column:
    """Cells of a line that was quoted as a whole."""
    inner = F.regexp_replace(F.regexp_replace(line, '^"|"$', ""), '""', '"')
    return F.transform(F.split(inner, re.escape(sep)), lambda c: F.btrim(c, F.lit('"')))


def dbf_fields(head: bytes) -> list[tuple[str, str, int, int]]:
    """(name, type, length, decimals) of the fields of a dBASE header."""
    out, at = [], 32
    while at + 32 <= len(head) and head[at] != 0x0D:
        out.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return out


def dbf_records(data: bytes) -> Iterator[tuple[int, bool, dict[str, bytes]]]:
    """(number from 0, deleted, raw fields)."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields = dbf_fields(data[:head])
    for k in range(n):
        record = data[head + k * size : head + (k + 1) * size]
        if len(record) < size:
            return
        at, row = 1, {}
        for name, _, length, _ in fields:
            row[name] = record[at : at + length]
            at += length
        yield k, record[:1] == b"*", row


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8").strip(" \0")
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip(" \0")


DBF = "source_file string, source_row_number long, deleted boolean, fields map<string,string>, numeric_hex map<string,string>"


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """Records of dBASE files, deleted ones marked; the raw bytes of numeric fields as hex, for audits."""

    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                kinds = {n: k for n, k, *_ in dbf_fields(content[: struct.unpack("<H", content[8:10])[0]])}
                rows = [(name, k + 1, dead, {c: _text(v) for c, v in row.items()}, {c: v.hex() for c, v in row.items() if kinds[c] in "NF"}) for k, dead, row in dbf_records(content)]
                for lo in range(0, len(rows), 5000):
                    yield pd.DataFrame(rows[lo : lo + 5000], columns=["source_file", "source_row_number", "deleted", "fields", "numeric_hex"])

    return read_bytes(spark, path).select("path", "content").mapInPandas(run, DBF)


SHP = "source_file string, source_row_number long, kind string, parts array<array<struct<x:double,y:double>>>"


def shp_shapes(data: bytes) -> Iterator[tuple[int, str, list[list[tuple[float, float]]]]]:
    """(record number, kind, parts) of points, polylines and polygons."""
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else 0
        if kind in (1, 11, 21):
            yield number, "point", [[struct.unpack("<dd", body[4:20])]]
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            base = 44 + 4 * n_parts
            xy = struct.unpack(f"<{2 * n_points}d", body[base : base + 16 * n_points])
            points = list(zip(xy[::2], xy[1::2]))
            yield number, "polygon" if kind in (5, 15, 25) else "polyline", [points[a:b] for a, b in zip(starts, starts[1:])]


def read_shp(spark: SparkSession, path: str) -> DataFrame:
    def run(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"]):
                rows = [(name, k, kind, [[{"x": x, "y": y} for x, y in part] for part in parts]) for k, kind, parts in shp_shapes(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "source_row_number", "kind", "parts"])

    return read_bytes(spark, path).select("path", "content").mapInPandas(run, SHP)


def shapefile(spark: SparkSession, stem: str) -> DataFrame:
    """Shapes with their attributes, by record number."""
    return read_shp(spark, stem + ".shp").drop("source_file").join(read_dbf(spark, stem + ".dbf").where("not deleted"), "source_row_number")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines); a torn last line is a broken line, not an error."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r._corrupt is not null").select("value")


def read_geojson(spark: SparkSession, path: str, id_property: str, envelope: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(features, problems) of feature collections: id, properties, geometry as JSON; repeated ids, kinds and coordinates are checked."""
    doc = read_bytes(spark, path).select("path", F.from_json(decoded(F.col("content")), "type string, features array<struct<properties:map<string,string>, geometry:string>>").alias("d"))
    f = doc.select("path", F.posexplode("d.features").alias("position", "f")).select("path", "position", F.element_at("f.properties", F.lit(id_property)).alias("id"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))
    numbers = F.transform(F.regexp_extract_all(F.get_json_object("geometry", "$.coordinates"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    kind = F.get_json_object("geometry", "$.type")
    xs, ys = F.filter(numbers, lambda _, i: i % 2 == 0), F.filter(numbers, lambda _, i: i % 2 == 1)
    x0, y0, x1, y1 = envelope
    outside = (F.array_min(xs) < x0) | (F.array_max(xs) > x1) | (F.array_min(ys) < y0) | (F.array_max(ys) > y1)
    repeated = f.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    problem = F.when(F.col("id").isNull(), "no id").when(kind.isNull() | ~kind.isin("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon"), "kind").when(outside, "outside the envelope")
    return f, f.select("id", problem.alias("problem")).where("problem is not null").union(repeated)


def last_by_code(features: DataFrame, code: str) -> DataFrame:
    """Properties per code, the last feature's of equals."""
    return features.withColumn("code", F.element_at("properties", F.lit(code))).where("code is not null").groupBy("code").agg(F.max_by("properties", "position").alias("properties"))


PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(StructType([StructField("url", StringType()), StructField("label", StringType())]))), StructField("json_ld", ArrayType(StringType())), StructField("description", StringType()), StructField("options", ArrayType(StructType([StructField("field", StringType()), StructField("label", StringType()), StructField("value", StringType())])))])


@pandas_udf(PAGE)
def parse_page(pages: pd.Series) -> pd.DataFrame:
    """Title, visible text, links, JSON-LD, description and form options of HTML."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.out = {"title": "", "text": [], "links": [], "json_ld": [], "description": None, "options": []}
            self.skip, self.title, self.ld, self.link, self.field, self.option = 0, False, False, None, None, None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("script", "style", "noscript"):
                self.ld = a.get("type") == "application/ld+json"
                self.skip += 1
                if self.ld:
                    self.out["json_ld"].append("")
            elif tag == "title":
                self.title = True
            elif tag == "a" and a.get("href"):
                self.link = {"url": a["href"], "label": ""}
                self.out["links"].append(self.link)
            elif tag == "meta" and (a.get("name") or "").lower() == "description":
                self.out["description"] = a.get("content")
            elif tag == "select":
                self.field = a.get("name")
            elif tag == "option":
                self.option = {"field": self.field, "label": "", "value": a.get("value")}
                self.out["options"].append(self.option)

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript"):
                self.skip, self.ld = max(0, self.skip - 1), False
            elif tag == "title":
                self.title = False
            elif tag == "a":
                self.link = None
            elif tag in ("option", "select"):
                self.option = None

        def handle_data(self, data):
            if self.ld:
                self.out["json_ld"][-1] += data
            elif self.skip:
                return
            elif self.title:
                self.out["title"] += data
            else:
                self.out["text"].append(data)
                for target in (self.link, self.option):
                    if target is not None:
                        target["label"] = (target["label"] + " " + data).strip()

    rows = []
    for html in pages:
        r = Reader()
        r.feed(html or "")
        r.close()
        r.out["text"], r.out["title"] = " ".join(" ".join(r.out["text"]).split()), " ".join(r.out["title"].split())
        rows.append(r.out)
    return pd.DataFrame(rows, columns=PAGE.names)


FORM = StructType([StructField("fields", ArrayType(StructType([StructField("field", StringType()), StructField("value", StringType())]))), StructField("options", ArrayType(StructType([StructField("field", StringType()), StructField("label", StringType()), StructField("value", StringType()), StructField("count", LongType()), StructField("selected", BooleanType())])))])


@pandas_udf(FORM)
def parse_form(pages: pd.Series) -> pd.DataFrame:
    """What a page's controls would submit, by name, the last of a name; and the options of its selects with their counts.

    Disabled and unnamed controls, buttons and unchecked boxes are left out. Option end tags may be missing. A count
    stands in a label as `Elbe --- (1.234 values)`; the label goes without it.
    """
    from html.parser import HTMLParser

    class Controls(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.values: dict[str, str] = {}
            self.options: list[dict] = []
            self.select, self.option, self.area = None, None, None

        def close_option(self) -> None:
            if self.option is not None:
                words = " ".join(self.option["label"].split())
                label, _, tail = words.partition(" ---")
                found = re.match(r"\s*\(([\d.]+)", tail)
                value = self.option["value"]
                self.option.update(label=label.strip(), value=words if value is None else value, count=int(found[1].replace(".", "")) if found and found[1].strip(".") else None)
                self.options.append(self.option)
                self.option = None

        def close_select(self) -> None:
            self.close_option()
            own = [o for o in self.options if o["select"] == self.select]
            if own:
                self.values[self.select[1]] = next((o for o in own if o["selected"]), own[0])["value"]
            self.select = None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            name = None if "disabled" in a else a.get("name")
            if tag == "option":
                self.close_option()
                if self.select and "disabled" not in a:
                    self.option = {"select": self.select, "field": self.select[1], "label": "", "value": a.get("value"), "selected": "selected" in a}
            elif tag == "select":
                self.select = (len(self.options), name) if name else None
            elif tag == "textarea" and name:
                self.area = name
                self.values[name] = ""
            elif tag == "input" and name:
                kind = (a.get("type") or "text").lower()
                if kind not in ("submit", "image", "button", "reset", "file") and (kind not in ("checkbox", "radio") or "checked" in a):
                    self.values[name] = a.get("value") or ""

        def handle_endtag(self, tag):
            if tag == "option":
                self.close_option()
            elif tag == "select" and self.select:
                self.close_select()
            elif tag == "textarea":
                self.area = None

        def handle_data(self, data):
            if self.option is not None:
                self.option["label"] += data
            elif self.area is not None:
                self.values[self.area] = " ".join((self.values[self.area] + data).split())

    out = []
    for html in pages:
        c = Controls()
        c.feed(html or "")
        c.close()
        if c.select:
            c.close_select()
        out.append(([{"field": k, "value": v} for k, v in c.values.items()], [{k: v for k, v in o.items() if k != "select"} for o in c.options]))
    return pd.DataFrame(out, columns=FORM.names)


def label_positions(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(name, x, y) of ``names(name)`` from the lines ``labels(pos, text, x, y)`` of a map, as shares of its width and height.

    The first line equal to the name after normalising counts, else, for names of five characters or more, the first that
    contains it. Lines and names are those of one map; names without a line are absent.
    """
    lines = labels.select("pos", collapse_norm(F.col("text")).alias("key"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y")).where("key <> ''")
    wanted = names.select("name", collapse_norm(F.col("name")).alias("wanted")).where("wanted <> ''").distinct()
    first = F.min_by(F.struct("x", "y"), "pos").alias("at")
    equal = wanted.join(lines, F.col("wanted") == F.col("key")).groupBy("name", "wanted").agg(first)
    rest = wanted.where("length(wanted) >= 5").join(equal.select("name"), "name", "left_anti")
    inside = rest.join(lines, F.contains("key", "wanted")).groupBy("name").agg(first)
    return equal.select("name", "at.*").union(inside.select("name", "at.*"))


def infobox(html: Column) -> Column:
    """Map of an infobox table's header cells to their data cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>.*?</td>"), F.lit(1))
    cells = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>\s*<th[^>]*>.*?</th>\s*<td[^>]*>(.*?)</td>"), F.lit(1))
    plain = lambda a: F.transform(a, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    return F.map_from_entries(F.arrays_zip(plain(rows), plain(cells)))


#: Which adapter reads which file suffix, fixed values.
ADAPTERS = {"csv": "csv", "txt": "csv", "dbf": "dbf", "shp": "shapefile", "geojson": "geojson", "json": "json", "jsonl": "jsonl", "html": "html", "pdf": "blocks", "xlsx": "sheet"}


def inventory(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256, adapter, canonical_path): of files with equal content the least path is canonical."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    adapter = F.create_map(*(F.lit(x) for kv in ADAPTERS.items() for x in kv))[suffix]
    hashed = files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(adapter, F.lit("other")).alias("adapter"))
    return hashed.join(hashed.groupBy("sha256").agg(F.min("path").alias("canonical_path")), "sha256").select("path", "bytes", "sha256", "adapter", "canonical_path")


def column_registry(tables: dict[str, DataFrame], dictionary: list[str] | None = None) -> list[tuple[str, int, str, str, str | None]]:
    """(table, position, source name, column name, long name) of landed tables."""
    out = []
    for name, df in tables.items():
        long = long_names(df.columns, dictionary or [])
        out += [(name, k, s, c, long[s]) for k, (s, c) in enumerate(zip(df.columns, column_names(df.columns)), 1)]
    return out


def wfs_pages(pages: DataFrame, expected: int, filters: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(features, problems) of captured pages ``pages(offset, body)``: overlaps once, filters checked again, the hit count reconciled."""
    f = pages.select("offset", F.explode(F.from_json("body", "features array<struct<id:string, properties:map<string,string>, geometry:string>>")["features"]).alias("f")).select("offset", "f.*").dropDuplicates(["id"])
    wrong = F.lit(False)
    for k, v in filters.items():
        wrong = wrong | ~F.coalesce(F.element_at("properties", F.lit(k)) == v, F.lit(False))
    count = f.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("expected "), F.lit(str(expected)), F.lit(", found "), F.col("n").cast("string")).alias("problem"))
    return f.where(~wrong), f.where(wrong).select("id", F.lit("does not match the filter").alias("problem")).union(count)


def search_results(rows: DataFrame) -> DataFrame:
    """Hits of several services as (url, title, doi), each canonical URL once, the best rank first."""
    from limnos.operators.crawl import canonical_url

    doi = F.regexp_extract(F.coalesce("doi", "url"), r"(10\.\d{4,9}/\S+)", 1)
    url = canonical_url(F.coalesce("url", F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))))
    keyed = rows.select(url.alias("url"), "title", F.nullif(doi, F.lit("")).alias("doi"), "rank").where("url is not null")
    return keyed.groupBy("url").agg(F.min_by("title", "rank").alias("title"), F.max("doi").alias("doi"), F.min("rank").alias("rank"))
