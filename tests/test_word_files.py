"""Word files with styles, bullets and properties; broken ones; bundles of sections."""

import zipfile

from corpusloom.sources import readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style="", num=False):
    inner = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if num else "")
    return f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_elements_of_word_files(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    body = p("Top", "T1") + p("Part", "berschrift2") + p("plain") + p("") + p("one", num=True) + p("two", "ListBullet") + table
    with zipfile.ZipFile(tmp_path / "good.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="T1"><w:name w:val="Title"/></w:style><w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c:core xmlns:c="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator> Ann </dc:creator><dc:subject/></c:core>')
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("other", "x")
    rows = readers.read_docx_elements(spark, str(tmp_path)).collect()
    good = sorted((r.i, r.kind, r.level, r.text) for r in rows if r.path.endswith("good.docx"))
    assert good == [(0, "heading", 1, "Top"), (1, "heading", 2, "Part"), (2, "paragraph", None, "plain"), (3, "bullet", None, "one"), (4, "bullet", None, "two"), (5, "table", None, "a | b")]
    assert {tuple(sorted(r.properties.items())) for r in rows if r.path.endswith("good.docx")} == {(("creator", "Ann"), ("title", "T"))}
    broken = [r for r in rows if not r.path.endswith("good.docx")]
    assert len(broken) == 2 and all(r.error and r.text is None for r in broken)


def test_bundle(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string"), spark.createDataFrame([(0.5,)], "v double")
    readers.write_bundle({"a": a, "b": b}, str(tmp_path / "out"), {"name": "t"}, ("b", "none"))
    rows = {(r.section, r.row) for r in spark.read.schema("section string, row string").json(str(tmp_path / "out/bundle")).collect()}
    assert rows == {("a", '{"n":1,"s":"x"}'), ("a", '{"n":2}'), ("b", '{"v":0.5}')}
    assert [r.chart for r in spark.read.json(str(tmp_path / "out/charts")).collect()] == ["b"]
    assert spark.read.json(str(tmp_path / "out/a")).count() == 2 and spark.read.json(str(tmp_path / "out/metadata")).first()["value"] == "t"
