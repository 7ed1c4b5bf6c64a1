"""Readers and writers. Files are read by Spark; bytes that need decoding go through Arrow batches."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.arrow import strip_html

#: Fixed value: encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1258", "utf-16", "latin-1")
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for e in ENCODINGS:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes) -> str:
    """Paragraphs by lines, table rows as cells parted by ' | '."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORDS}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORDS}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{WORDS}p":
            out.append(text(e))
        elif e.tag == f"{WORDS}tbl":
            out += [" | ".join(text(c) for c in row.iter(f"{WORDS}tc")) for row in e.iter(f"{WORDS}tr")]
    return "\n".join(x for x in out if x.strip())


def docx_elements(raw: bytes) -> tuple[list[tuple[str, int | None, str]], dict[str, str]]:
    """((kind, heading level, text) of each paragraph and table row, core properties) of a Word file.

    A paragraph's kind follows its style's name ("heading 2", "title", "list ..."), else a numbering makes it a bullet.
    """
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        body, styles, core = tree("word/document.xml").find(f"{WORDS}body"), tree("word/styles.xml"), tree("docProps/core.xml")
    value = lambda e: "" if e is None else e.get(f"{WORDS}val", "")
    named = {s.get(f"{WORDS}styleId", ""): value(s.find(f"{WORDS}name")).lower() for s in styles.iter(f"{WORDS}style")} if styles is not None else {}
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORDS}t")).strip()
    out: list[tuple[str, int | None, str]] = []
    for e in body if body is not None else ():
        if e.tag == f"{WORDS}p" and text(e):
            style_id = value(e.find(f"{WORDS}pPr/{WORDS}pStyle"))
            style = named.get(style_id, style_id.lower())
            digits = "".join(c for c in style if c.isdigit())
            if style.startswith("heading") or style == "title":
                out.append(("heading", int(digits) if digits else 1, text(e)))
            elif "list" in style or e.find(f"{WORDS}pPr/{WORDS}numPr") is not None:
                out.append(("bullet", None, text(e)))
            else:
                out.append(("paragraph", None, text(e)))
        elif e.tag == f"{WORDS}tbl":
            rows = (" | ".join(text(c) for c in row.iter(f"{WORDS}tc")) for row in e.iter(f"{WORDS}tr"))
            out += [("table", None, r) for r in rows if r.strip(" |")]
    return out, {c.tag.split("}")[1]: c.text.strip() for c in core if c.text and c.text.strip()} if core is not None else {}


def read_docx_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, kind, level, text, properties, error): the elements of each Word file in order; a file that cannot be read is one row with its error."""
    kind = "struct<elements: array<struct<i: int, kind: string, level: int, text: string>>, properties: map<string, string>, error: string>"

    def one(raw: bytes) -> dict:
        try:
            found, properties = docx_elements(bytes(raw))
            return {"elements": [{"i": i, "kind": k, "level": n, "text": t} for i, (k, n, t) in enumerate(found)], "properties": properties, "error": None}
        except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as e:
            return {"elements": [], "properties": {}, "error": f"{type(e).__name__}: {e}"}

    read = F.pandas_udf(lambda c: pd.DataFrame([one(b) for b in c]), kind)
    rows = _files(spark, path, ".docx").select("path", read("content").alias("r"))
    return rows.select("path", F.explode_outer("r.elements").alias("e"), "r.properties", "r.error").select("path", "e.*", "properties", "error")


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)


def read_text_files(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(path, text) with the encoding found by trial."""
    return _files(spark, path, suffix).select("path", F.pandas_udf(lambda c: c.map(lambda b: decode(bytes(b))), "string")("content").alias("text"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, ".docx").select("path", F.pandas_udf(lambda c: c.map(lambda b: docx_text(bytes(b))), "string")("content").alias("text"))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    return read_text_files(spark, path, ".html").select("path", strip_html("text").alias("text"))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None, schema: str | None = None) -> DataFrame:
    """JSON lines, blank ones skipped; a limit of None or at most 0 reads all."""
    r = spark.read.schema(schema) if schema else spark.read
    df = r.json(path)
    return df.limit(limit) if limit and limit > 0 else df


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, JSON or JSON lines, by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.option("multiLine", str(path.endswith(".json")).lower()).json(path)
    raise ValueError(f"unknown suffix: {path}")


READERS = {".txt": read_text_files, ".md": lambda s, p: read_text_files(s, p, ".md"), ".docx": read_docx, ".html": read_html_files}


def read_any(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md", ".docx", ".html")) -> DataFrame:
    """All known files below ``path``, by suffix."""
    frames = [READERS[s](spark, path).withColumn("kind", F.lit(s)) for s in suffixes]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pick_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first candidate among the columns, without regard to case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[c] for c in candidates if c in have), None)


def read_runs(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Persisted runs: one JSON object a file, named by 32 hexadecimal digits, newest first."""
    r = spark.read.option("multiLine", "true")
    df = (r.schema(schema) if schema else r).json(path).withColumns({"file": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")})
    return df.where(F.col("file").rlike(r"^[0-9a-f]{32}\.json$")).orderBy(F.desc("modified"))


def rss_links(feeds: DataFrame, column: str = "xml", limit: int = 50) -> DataFrame:
    """(link, pos): item links of the feeds, first occurrence kept."""
    links = feeds.select(F.posexplode(F.expr(f"xpath({column}, '//item/link/text()')")).alias("pos", "link"))
    first = F.row_number().over(Window.partitionBy("link").orderBy("pos"))
    return links.withColumn("nth", first).where("nth = 1").orderBy("pos", "link").limit(limit).select("link", "pos")


def best_extraction(candidates: DataFrame) -> DataFrame:
    """Of several extractions of a document (document_id, engine, text, quality) the best; later engines count only if the earlier ones stay below 0.3."""
    w = Window.partitionBy("document_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    tried = candidates.withColumn("before", F.max("quality").over(w)).where(F.col("before").isNull() | (F.col("before") < 0.3))
    return tried.groupBy("document_id").agg(F.max_by(F.struct("engine", "text", "quality"), F.struct("quality", -F.col("rank"))).alias("b")).select("document_id", "b.*")


# sinks
def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder a section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_bundle(sections: dict[str, DataFrame], path: str, metadata: dict[str, str], charts: tuple[str, ...] = ()) -> None:
    """A folder for each section, ``metadata``, ``charts`` (an index of the sections that are drawn), and all sections as one table of (section, row)."""
    write_sections(sections, path)
    spark = next(iter(sections.values())).sparkSession
    spark.createDataFrame([(k, v) for k, v in metadata.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    spark.createDataFrame([(c, f"{path}/{c}") for c in charts if c in sections], "chart string, data string").coalesce(1).write.mode("overwrite").json(f"{path}/charts")
    for n, (name, df) in enumerate(sections.items()):
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        rows.write.mode("append" if n else "overwrite").json(f"{path}/bundle")


def append_runs(df: DataFrame, path: str, at: str = "created_at") -> None:
    """Runs as Parquet, partitioned by day."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join(str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key: one anti join, no ranking."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents without ``gone`` (a column of keys) and children without theirs."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    return parents.join(g, F.col(key) == F.col("__gone"), "left_anti"), children.join(g, F.col(foreign) == F.col("__gone"), "left_anti")


