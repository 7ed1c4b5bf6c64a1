"""Bodies of official letters; texts that are no letters stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import letters
from corpusloom.functions.arrow import fix_glued_words
from corpusloom.functions.dialect import SPARK
from corpusloom.functions.text import col
from corpusloom.session import sql_over, stored


def clean_letters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, letter): glued words of scans parted; of letters the body's lines, runs of blank lines made one.

    Null texts stay null; rows that share an id are cleaned as one text only if they share it, too. Letters are stored and
    their lines shuffled; other texts stay in the task that reads them.
    """
    given = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("doc_id"), F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), fix_glued_words(text_col)).alias("text"))
    marked = given.withColumn("letter", F.coalesce(col(letters.is_letter, "text"), F.lit(False)))
    own = stored(marked.where("letter"), "letters")
    found = own.select("doc_id", "text").distinct()
    lines = sql_over(lambda x: letters.lines_of(SPARK, x), found)
    kept = sql_over(lambda x: letters.body(SPARK, f"SELECT * FROM {x}", letters.HEAD_LINES), lines).withColumn("kept", F.lit(True))
    both = lines.join(kept.hint("merge"), ["doc_id", "i"], "left").where(F.col("kept") | F.trim("line").eqNullSafe(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    bodies = both.groupBy("doc_id").agg(F.regexp_replace(F.regexp_replace(text, r"\n\s*\n\s*\n", "\n\n"), r"^\s+|\s+$", "").alias("body"))
    cleaned = own.join(bodies.hint("merge"), "doc_id", "left").select(F.col("id").alias(id_col), F.coalesce("body", F.lit("")).alias(text_col), "letter")
    return marked.where(~F.col("letter")).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "letter").unionByName(cleaned)


def clean_letter_elements(elements: DataFrame, id_col: str = "doc_id", order_col: str = "i", text_col: str = "text") -> DataFrame:
    """``elements`` without what is no body in the documents that are letters by all their elements together; blank elements of letters go."""
    names = elements.columns
    given = elements.select(F.col(id_col).alias("doc_id"), F.col(order_col).alias("o"), F.coalesce(F.col(text_col), F.lit("")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    found = given.groupBy("doc_id").agg(fix_glued_words(joined).alias("text")).where(col(letters.is_letter, "text")).select(F.col("doc_id").alias("own"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("o")) - 1
    lines = given.join(found, F.col("doc_id") == F.col("own"), "left_semi").withColumn("i", place)
    kept = sql_over(lambda x: letters.body(SPARK, f"SELECT doc_id, i, line FROM {x}", letters.HEAD_ELEMENTS), lines)
    stays = lines.join(kept, ["doc_id", "i"]).select(F.col("doc_id").alias("own"), F.col("o").alias("at"))
    letter = elements.join(found, F.col(id_col) == F.col("own"), "left_semi")
    body = letter.join(stays, (F.col(id_col) == F.col("own")) & (F.col(order_col) == F.col("at")), "left_semi")
    return elements.join(found, F.col(id_col) == F.col("own"), "left_anti").select(*names).unionByName(body.select(*names))
