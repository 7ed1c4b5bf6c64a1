"""PDF and Word files as Spark data sources: ``spark.read.format("pdf").load(folder)``, also by CREATE TABLE ... USING.

Files are dealt into partitions of at most ``group_mb`` (a larger file is one of its own), read where they are parsed,
and give a row for each element; a file that cannot be read gives one row with its error. Files that share a name's
beginning of "_" or "." are hidden. Folders are listed once, on the driver: names and sizes only.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions.pdf import pdf_elements
from corpusloom.sources.readers import docx_elements

SCHEMA = "path string, page int, i int, kind string, level int, text string, properties map<string, string>, error string"
ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("i", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("properties", pa.map_(pa.string(), pa.string())), ("error", pa.string())])
#: What a file that is no such file, or a broken one, makes its parser raise.
BROKEN = (ValueError, KeyError, IndexError, TypeError, AttributeError, OSError, RecursionError, zipfile.BadZipFile, ElementTree.ParseError)


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def file_groups(files: list[tuple[str, int]], most_bytes: int) -> list[list[str]]:
    """Paths in order, in groups of at most ``most_bytes``; a larger file is a group of its own."""
    out: list[list[str]] = []
    held = 0
    for path, size in sorted(files):
        if not out or held + size > most_bytes:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


class ElementReader(DataSourceReader):
    def __init__(self, options: dict[str, str], suffix: str, parse):
        if "path" not in options:
            raise ValueError("no path is given")
        self.uri, self.suffix, self.parse = options["path"], suffix, parse
        self.most_bytes = int(float(options.get("group_mb", "64")) * (1 << 20))

    def partitions(self) -> list[FileGroup]:
        store, root = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        every = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in every if f.is_file and f.base_name.lower().endswith(self.suffix) and f.base_name[:1] not in "._"]
        return [FileGroup(g) for g in file_groups(files, self.most_bytes)] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as f:
                    elements, properties = self.parse(f.read())
                rows = [(path, page, i, kind, level, text, list(properties.items()), None) for i, (page, kind, level, text) in enumerate(elements)]
                rows = rows or [(path, None, None, None, None, None, list(properties.items()), None)]
            except BROKEN as e:
                rows = [(path, None, None, None, None, None, [], f"{type(e).__name__}: {e}")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


def word_rows(raw: bytes):
    elements, properties = docx_elements(raw)
    return [(None, *e) for e in elements], properties


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options, ".pdf", pdf_elements)


class WordSource(PdfSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options, ".docx", word_rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)
    spark.dataSource.register(WordSource)


def page_texts(elements: DataFrame) -> DataFrame:
    """(path, page, text): the elements of each page in order, by lines; broken and empty files give none."""
    rows = elements.where("text IS NOT NULL").groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("e"))
    return rows.select("path", "page", F.array_join("e.text", "\n").alias("text"))


def section_texts(elements: DataFrame) -> DataFrame:
    """(path, section, heading, text): what follows each heading, section 0 being what precedes the first."""
    before = "sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i)"
    rows = elements.where("text IS NOT NULL").withColumn("section", F.expr(before))
    heading = F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("heading")
    body = F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("i", "text")))).alias("e")
    return rows.groupBy("path", "section").agg(heading, body).select("path", "section", "heading", F.array_join("e.text", "\n").alias("text"))
