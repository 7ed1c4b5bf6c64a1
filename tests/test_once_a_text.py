"""Texts cleaned once and where they are read: same rows on repeated and null ids, no shuffle of words or texts."""

import re
import unicodedata

import duckdb
import pytest

from corpusloom.functions import arrow
from corpusloom.plans import registry

TEXTS = ["one one one one two three four five.", "one one two", "a b c d e f g h i", "{{<<>>}} [x] | \\ end", None, "", "five six seven eight nine ten eleven twelve.", "Số: 12/QĐ\nQuyết định\nNội dung công văn\n\n\n\nhết", "Mệt. " * 9]


@pytest.mark.parametrize("name", ["is_bad_generation", "preprocess_report", "admin_clean_lines"])
def test_rows_of_odd_tables_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(i, "s", x) for i, x in enumerate(TEXTS)] + [(1, "s", "one one one one one one"), (1, "s", TEXTS[6]), (2, "s", TEXTS[2])] * (name != "admin_clean_lines") + [(None, "s", TEXTS[0])] * (name == "is_bad_generation")
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted((tuple(r[c] for c in names) for r in registry.queries()[name](spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, cur.fetchall()), key=repr)


def plan(spark, sf, name):
    return registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_no_word_and_no_text_is_shuffled(spark, sf):
    words = plan(spark, sf, "is_bad_generation")
    assert "Generate" not in words and "hashpartitioning" not in words
    branches = [x for x in re.split(r"\n(?=[ +:|-]*(?:Project|Union|Scan))", plan(spark, sf, "admin_clean_lines")) if "documents.parquet" in x]
    assert branches and not any("hashpartitioning" in x for x in branches)


@pytest.mark.parametrize("name", ["is_bad_generation", "preprocess_report"])
def test_texts_are_cleaned_once(spark, sf, name):
    optimized = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("translate(") == 1


def test_glued_words_are_sought_where_there_are_any(monkeypatch):
    class No:
        def sub(self, *_):
            raise AssertionError("the pattern was tried")

    assert arrow.part_glued("Đồán TỰĐỘNG") == "Đồ án TỰ ĐỘNG"
    monkeypatch.setattr(arrow, "_GLUED", No())
    assert arrow.part_glued("plain " * 9) == "plain " * 9 and arrow.part_glued("déjà vu, größer") == "déjà vu, größer"


def test_element_text_by_characters():
    """The patterns leave of every character what its category says."""
    for c in map(chr, [*range(0x3000), 0xFEFF, 0xFF11, 0x1F600, 0x1D7D8, 0xE0101]):
        if ord(c) not in arrow.PUNCTUATION and c not in "\r\n":
            t = unicodedata.normalize("NFC", f"a{c}b")
            want = "".join(x if x.isalnum() or x in " \t_.,;:!?()/%+-|\"'" or unicodedata.category(x)[0] == "M" else " " for x in t)
            assert arrow.element_text(f"a{c}b", "paragraph") == " ".join(want.split())


def test_clean_element_takes_one_pass(spark, sf):
    assert plan(spark, sf, "clean_element").count("MapInArrow") == 1 and "ArrowEvalPython" not in plan(spark, sf, "clean_element")
