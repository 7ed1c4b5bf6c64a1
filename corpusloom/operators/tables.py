"""Table functions for SQL: chunkers and sections by LATERAL joins, folds over ordered lines by PARTITION BY and ORDER BY."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpusloom.operators import chunk
from corpusloom.session import sql_over, stored


@udtf(returnType="index int, text string, tokens int")
class Chunks:
    """``chunks(text, how)``: the chunks of a text by the named chunker."""

    def eval(self, text: str, how: str) -> Iterator[tuple]:
        for c in chunk.CHUNKERS[how](text or ""):
            yield c["index"], c["text"], c["tokens"]


@udtf(returnType="i int, kind string, level int, path array<string>, text string")
class Sections:
    """``sections(text)``: each line of a text with its kind, heading level and path of open headings."""

    def eval(self, text: str) -> Iterator[tuple]:
        for s in chunk.sections(text or ""):
            yield s["i"], s["kind"], s["level"], s["path"], s["text"]


@udtf(returnType="doc_id long, i int, kind string, level int, path array<string>, text string")
class SectionPaths:
    """``section_paths(TABLE(lines) PARTITION BY doc_id ORDER BY i)``: as ``sections`` over a table (doc_id, i, line).

    Of a document only the open headings are held, whatever its length.
    """

    def __init__(self) -> None:
        self.path: list[str] = []

    def eval(self, row: Row) -> Iterator[tuple]:
        line = (row["line"] or "").strip()
        if line:
            kind, level = chunk.line_kind(line)
            if level:
                self.path = [*self.path[: level - 1], line]
            yield row["doc_id"], row["i"], kind, level, list(self.path), line


@udtf(returnType="doc_id long, index int, text string")
class Paragraphs:
    """``paragraphs(TABLE(lines) PARTITION BY doc_id ORDER BY i)``: lines that a break has parted are joined; one paragraph is held."""

    def __init__(self) -> None:
        self.doc, self.held, self.n = None, None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        line = (row["line"] or "").strip()
        if not line:
            return
        if self.held is not None and chunk.goes_on(self.held, line):
            self.held += " " + line
            return
        yield from self.terminate()
        self.doc, self.held = row["doc_id"], line

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self.doc, self.n, self.held
            self.n += 1


#: What chunks of elements are given as.
MADE = "doc_id long, index int, made int, text string, tokens int, path array<string>, elements array<int>, kinds array<string>, page_start int, page_end int"
KINDS = {"index": pa.int32(), "made": pa.int32(), "text": pa.string(), "tokens": pa.int32(), "path": pa.list_(pa.string()), "elements": pa.list_(pa.int32()), "kinds": pa.list_(pa.string()), "page_start": pa.int32(), "page_end": pa.int32()}


@udtf(returnType=MADE)
class ElementChunks:
    """``element_chunks(TABLE(elements) PARTITION BY doc_id ORDER BY (i), most, target, least, overlap, turn)``: see chunk.ElementPacker.

    The table has (doc_id, i, page, kind, path, text) in any order of columns.
    """

    def __init__(self) -> None:
        self.packer, self.doc = None, None

    def eval(self, row: Row, most: int, target: int, least: int, overlap: int, turn: float) -> Iterator[tuple]:
        self.packer = self.packer or chunk.ElementPacker(most, target, least, overlap, turn)
        self.doc = row["doc_id"]
        yield from self.rows(self.packer.add(row.asDict()))

    def terminate(self) -> Iterator[tuple]:
        if self.packer:
            yield from self.rows(self.packer.close())

    def rows(self, chunks: list[dict]) -> Iterator[tuple]:
        return ((self.doc, *c.values()) for c in chunks)


def element_chunks(elements: DataFrame, most: int = 640, target: int = 420, least: int = 120, overlap: int = 64, turn: float | None = None) -> DataFrame:
    """Chunks of ``elements`` (doc_id, i, page, kind, path, text), with the section's path, the elements and pages they come from and chunk_id."""
    register(elements.sparkSession)
    turn_sql = "CAST(NULL AS DOUBLE)" if turn is None else f"{float(turn)}D"
    sizes = f"{int(most)}, {int(target)}, {int(least)}, {int(overlap)}, {turn_sql}"
    made = sql_over(lambda t: f"SELECT * FROM element_chunks(TABLE({t}) PARTITION BY doc_id ORDER BY (i), {sizes})", elements.select("doc_id", "i", "page", "kind", "path", "text"))
    return with_chunk_id(made)


def with_chunk_id(made: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("made").cast("string"), F.substring("text", 1, 512))
    return made.withColumn("chunk_id", F.substring(F.sha1(key), 1, 20)).drop("made")


#: Elements of a document that are packed at once.
ELEMENTS_HELD = 1024


def line_chunks(docs: DataFrame, turn: float | None = None) -> DataFrame:
    """``element_chunks`` of the lines of ``docs`` (doc_id, text) with their ``section_paths``: in the task that reads a text, with no row for a line.

    Only documents that repeat an id are shuffled: their lines are put together, in order of their numbers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = stored(docs.groupBy(F.col("doc_id").alias("of")).count().where("count > 1").select("of"), "repeated")
    if not repeated.limit(1).count():
        return with_chunk_id(docs.mapInArrow(packed_lines(turn), MADE))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    lone = with_chunk_id(docs.join(repeated, same, "left_anti").mapInArrow(packed_lines(turn), MADE))
    register(docs.sparkSession)
    lines = docs.join(repeated, same, "left_semi").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    paths = sql_over(lambda t: f"SELECT doc_id, i, CAST(NULL AS INT) AS page, kind, path, text FROM section_paths(TABLE({t}) PARTITION BY doc_id ORDER BY i)", lines)
    return lone.unionByName(element_chunks(paths, turn=turn))


def packed_lines(turn: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text) into the chunks of each text's lines, some documents at a time."""

    def chunks(text: str) -> Iterator[dict]:
        packer = chunk.ElementPacker(turn=turn)
        elements = chunk.sections(text)
        for k in range(0, len(elements), ELEMENTS_HELD):
            yield from packer.add_all(elements[k : k + ELEMENTS_HELD])
        yield from packer.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), chunk.DOCUMENTS_HELD):
                part = b.slice(at, chunk.DOCUMENTS_HELD)
                row, found = [], []
                for i, text in enumerate(part.column(1)):
                    made = list(chunks(text.as_py() or ""))
                    row += [i] * len(made)
                    found += made
                columns = [pa.array([c[name] for c in found], kind) for name, kind in KINDS.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *columns], names=["doc_id", *KINDS])

    return run


def register(spark: SparkSession) -> None:
    for name, f in (("chunks", Chunks), ("sections", Sections), ("section_paths", SectionPaths), ("paragraphs", Paragraphs), ("element_chunks", ElementChunks)):
        spark.udtf.register(name, f)
