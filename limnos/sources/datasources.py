"""Python data sources for files whose records can be addressed: one file is read by many tasks.

* ``dbf``: partitions by record range; records have one length, so a range is a seek.
* ``shp``: partitions by ranges of the ``.shx`` index beside it; without an index, one task reads the file.
* ``captured_pages``: pages of a paged service under ``layer=<name>/start=<offset>/``; filters on layer, start,
  feature_id and the key property are pushed into the source: pages are not opened, features not built.
* ``whole_files``: a writer of ``(name, body)``, each row a file of its own, for many small files of any layout.

Ranges and pages are dealt to TASKS tasks where there are more of them than that.

Paths may be local or a URI that Arrow's file systems open. ``register`` makes the formats known to a session.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.window import Window

from limnos.sources.readers import _text, dbf_fields, shp_shapes

RECORDS = 100_000
#: Most tasks of a scan, and files whose heads are read at once.
TASKS, HEADS = 400, 32


@dataclass
class Dealt(InputPartition):
    """Neighbouring ranges or pages that one task reads, one after the other."""

    parts: list


def _dealt(parts: list) -> list[InputPartition]:
    """All parts, in their order, in at most TASKS partitions, one at least."""
    size = max(1, -(-len(parts) // TASKS))
    return [Dealt(parts[k : k + size]) for k in range(0, len(parts), size)] or [Dealt([])]


def _system(path: str) -> tuple:
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> tuple[object, list]:
    """(file system, its files that end so) for a file or folder."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return system, [info]
    return system, sorted((f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffix)), key=lambda f: f.path)


@dataclass
class Range:
    path: str
    first: int
    last: int


class DbfReader(DataSourceReader):
    def __init__(self, path: str, records: int, suffix: str) -> None:
        self.path, self.records, self.suffix = path, records, suffix

    def partitions(self) -> list[InputPartition]:
        system, files = _files(self.path, self.suffix)

        def ranges(f) -> list[Range]:
            with system.open_input_file(f.path) as file:
                n, head, size = struct.unpack("<IHH", file.read(12)[4:])
            n = min(n, max(0, f.size - head) // size) if size else 0  # a file that was cut short ends with its last whole record
            return [Range(f.path, lo, min(lo + self.records, n)) for lo in range(0, n, self.records)]

        with ThreadPoolExecutor(HEADS) as heads:
            return _dealt([r for found in heads.map(ranges, files) for r in found])

    def read(self, partition: Dealt) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for part in partition.parts:
            yield from self._range(system, part)

    def _range(self, system, partition: Range) -> Iterator[tuple]:
        with system.open_input_file(partition.path) as file:
            head = file.read(struct.unpack("<H", file.read(10)[8:])[0] - 10)
            fields, (head_size, size) = dbf_fields(b"\0" * 10 + head), (len(head) + 10, 0)
            file.seek(10)
            size = struct.unpack("<H", file.read(2))[0]
            file.seek(head_size + partition.first * size)
            for lo in range(partition.first, partition.last, 10_000):
                block = file.read(size * (min(lo + 10_000, partition.last) - lo))
                for k in range(len(block) // size):
                    record, at, row = block[k * size : (k + 1) * size], 1, {}
                    for name, kind, length, _ in fields:
                        row[name] = (kind, record[at : at + length])
                        at += length
                    yield partition.path, lo + k + 1, record[:1] == b"*", {c: _text(v) for c, (_, v) in row.items()}, {c: v.hex() for c, (kind, v) in row.items() if kind in "NF"}


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> str:
        return "source_file string, source_row_number long, deleted boolean, fields map<string,string>, numeric_hex map<string,string>"

    def reader(self, schema) -> DbfReader:
        return DbfReader(self.options["path"], int(self.options.get("records", RECORDS)), self.options.get("suffix", ".dbf"))


class ShpReader(DataSourceReader):
    def __init__(self, path: str, records: int) -> None:
        self.path, self.records = path, records

    @staticmethod
    def _index(system, path: str):
        """The index beside a shapefile, if there is one."""
        from pyarrow import fs

        found = [i for i in system.get_file_info([path[:-1] + "x", path[:-1] + "X"]) if i.type == fs.FileType.File]
        return found[0] if found else None

    def partitions(self) -> list[InputPartition]:
        system, files = _files(self.path, ".shp")
        out: list[Range] = []
        for f in files:
            index = self._index(system, f.path)
            n = (index.size - 100) // 8 if index else 0
            out += [Range(f.path, lo, min(lo + self.records, n)) for lo in range(0, n, self.records)] if index else [Range(f.path, 0, -1)]
        return _dealt(out)

    def read(self, partition: Dealt) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for part in partition.parts:
            yield from self._range(system, part)

    def _range(self, system, partition: Range) -> Iterator[tuple]:
        with system.open_input_file(partition.path) as file:
            if partition.last < 0:
                stretches = [(100, file.size())]
            else:
                with system.open_input_file(self._index(system, partition.path).path) as index:
                    index.seek(100 + 8 * partition.first)
                    words = struct.iter_unpack(">ii", index.read(8 * (partition.last - partition.first)))
                    stretches = [(2 * at, 2 * at + 8 + 2 * n) for at, n in words]
            for lo, hi in stretches:
                file.seek(lo)
                for number, kind, parts in shp_shapes(b"\0" * 100 + file.read(hi - lo)):
                    yield partition.path, number, kind, [[(x, y) for x, y in part] for part in parts]


class ShpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        return "source_file string, source_row_number long, kind string, parts array<array<struct<x:double,y:double>>>"

    def reader(self, schema) -> ShpReader:
        return ShpReader(self.options["path"], int(self.options.get("records", RECORDS)))


@dataclass
class Page:
    path: str
    layer: str
    start: int


class PagesReader(DataSourceReader):
    """Pages as parts of partitions. What ``pushFilters`` takes over is evaluated here and nowhere else."""

    def __init__(self, path: str, key: str) -> None:
        self.path, self.key = path, key
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in ("layer", "feature_id", "key", "start") and values is not None:
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name in ("layer", "feature_id", "key", "start") and isinstance(f, IsNotNull):
                self.present.add(name)
            elif name == "start" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "start" and isinstance(f, (LessThan, LessThanOrEqual)):
                bound = f.value + isinstance(f, LessThanOrEqual)
                self.high = bound if self.high is None else min(self.high, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        _, files = _files(self.path, "")
        out: list[Page] = []
        for f in files:
            m = re.search(r"(?:^|/)layer=([^/]*)/start=(\d+)/[^/_.][^/]*$", f.path)
            if m and self._asked("layer", m[1]) and self._asked("start", int(m[2])) and int(m[2]) >= self.low and (self.high is None or int(m[2]) < self.high):
                out.append(Page(f.path, m[1], int(m[2])))
        return _dealt(out)

    def _asked(self, name: str, value: object) -> bool:
        return (name not in self.wanted or value in self.wanted[name]) and (name not in self.present or value is not None)

    def read(self, partition: Dealt) -> Iterator[tuple]:
        system, _ = _system(self.path)
        for part in partition.parts:
            yield from self._page(system, part)

    def _page(self, system, partition: Page) -> Iterator[tuple]:
        with system.open_input_file(partition.path) as file:
            body = json.loads(file.read() or b"{}")
        for f in body.get("features") or []:
            properties = {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}
            key = properties.get(self.key)
            if self._asked("feature_id", f.get("id")) and self._asked("key", key):
                yield partition.layer, partition.start, f.get("id"), key, properties, json.dumps(f["geometry"]) if f.get("geometry") else None


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return "layer string, start long, feature_id string, key string, properties map<string,string>, geometry string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"], self.options.get("key", "id"))


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _system(self.path)
        last = None
        for name, body in iterator:
            at = f"{root}/{name}"
            folder = at.rpartition("/")[0]
            if folder != last:
                system.create_dir(folder, recursive=True)
                last = folder
            part = f"{folder}/_{uuid.uuid4()}"  # a repeated task replaces whole files
            with system.open_output_stream(part) as file:
                file.write(bytes(body))
            system.move(part, at)
        return WriterCommitMessage()


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return "name string, body binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats known, and let Spark push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (DbfSource, ShpSource, PagesSource, FilesSource):
        spark.dataSource.register(source)


def capture_state(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """What a capture has and where it resumes, from ``captured_pages`` and ``expected(layer, hits, seen_hits)``.

    Per layer: pages, features, repeated (features that came before), next_start (the first offset that no page without a
    gap before it reaches), complete, drifted (the service now counts other hits than when the capture began).
    """
    sizes = pages.groupBy("layer", "start").agg(F.count("feature_id").alias("n"), F.countDistinct("feature_id").alias("ids"))
    order = Window.partitionBy("layer").orderBy("start")
    reached = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = sizes.withColumn("reached", reached).withColumn("joined", F.min((F.col("start") == F.col("reached")).cast("int")).over(order))
    ids = pages.groupBy("layer", "feature_id").agg(F.count("*").alias("n")).groupBy("layer").agg((F.sum("n") - F.count("*")).alias("repeated"))
    state = gap.groupBy("layer").agg(F.count("*").alias("pages"), F.sum("n").alias("features"), F.sum(F.when(F.col("joined") == 1, F.col("n")).otherwise(0)).alias("next_start"))
    out = expected.join(state, "layer", "left").join(ids, "layer", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = out.select("layer", "hits", "seen_hits", *(zero(c) for c in ("pages", "features", "next_start", "repeated")))
    return counts.select("layer", "pages", "features", "next_start", "repeated", ((F.col("next_start") == F.col("hits")) & (F.col("repeated") == 0) & (F.col("hits") == F.col("seen_hits"))).alias("complete"), (F.col("hits") != F.col("seen_hits")).alias("drifted"))
