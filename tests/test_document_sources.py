"""PDF and Word files as data sources: files made here give their pages, headings, bullets and properties; broken ones an error row."""

import zipfile
import zlib

import pytest

from corpusloom.functions.pdf import Pdf, pdf_elements, values
from corpusloom.sources import documents


def pdf(pages, fonts=b"<< /F1 4 0 R >>", extra=(), info=b"<< /Title (A \\(small\\) title) /Author <FEFF004100E9> >>", flate=True, packed=False):
    """A file of these content streams; objects: 1 catalogue, 2 page tree, 3 properties, 4 font, then extra, then pages."""
    first = 5 + len(extra)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    plain = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font %s >> >>" % (kids, len(pages), fonts), info, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", *extra]
    for i, content in enumerate(pages):
        body = zlib.compress(content) if flate else content
        head = b"/Filter /FlateDecode " if flate else b""
        plain += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (first + 2 * i + 1), b"<< %s/Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)]
    out = b"%PDF-1.5\n"
    if packed:  # all but streams in one object stream
        inside = [(n, o) for n, o in enumerate(plain, 1) if b"stream" not in o]
        table, bodies = b"", b""
        for n, o in inside:
            table += b"%d %d " % (n, len(bodies))
            bodies += o + b"\n"
        data = zlib.compress(table + bodies)
        out += b"900 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(inside), len(table), len(data), data)
    for n, o in enumerate(plain, 1):
        if not packed or b"stream" in o:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    return out + b"trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF"


FIRST = rb"""BT /F1 24 Tf 72 720 Td (Great heading) Tj ET
BT /F1 11 Tf 72 680 Td 13 TL (A paragraph of text that goes) Tj T* [(on in the ne) 20 (xt) -400 (line.)] TJ
0 -40 Td (\225 one) Tj 0 -13 Td (\225 two) Tj ET"""
SECOND = b"BT /F1 16 Tf 1 0 0 1 72 700 Tm (Part) Tj ET BT /F1 11 Tf 1 0 0 1 72 660 Tm (Left) Tj 1 0 0 1 200 660 Tm (right \\247\\0511) Tj ET"
WANT = [
    (1, "heading", 1, "Great heading"),
    (1, "paragraph", None, "A paragraph of text that goes on in the next line."),
    (1, "bullet", None, "one"),
    (1, "bullet", None, "two"),
    (2, "heading", 2, "Part"),
    (2, "paragraph", None, "Left right §)1"),
]


@pytest.mark.parametrize("how", [{}, {"flate": False}, {"packed": True}])
def test_elements(how):
    elements, properties = pdf_elements(pdf([FIRST, SECOND], **how))
    assert elements == WANT
    assert properties == {"title": "A (small) title", "author": "Aé"}


def test_fonts_with_tables():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <1EA4> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    extra = [b"<< /Subtype /Type0 /DescendantFonts [<< /DW 600 /W [1 [500 500] 16 18 400] >>] /ToUnicode 6 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap), b"<< /Subtype /Type1 /Encoding << /Differences [65 /uni0111 /b] >> >>"]
    page = b"BT /F2 10 Tf 10 10 Td <0001000200100011001200200021FFFF> Tj /F3 10 Tf ( ABC) Tj ET"
    elements, _ = pdf_elements(pdf([page], fonts=b"<< /F2 5 0 R /F3 7 0 R >>", extra=extra))
    assert [e[3] for e in elements] == ["Ấfiabcxy� đbC"]


def test_forms_pictures_and_later_objects():
    form = b"<< /Subtype /Form /Resources << /Font << /F9 4 0 R >> >> /Length 42 >>\nstream\nBT /F9 10 Tf 10 300 Td (inside form) Tj ET\nendstream"
    page = b"BI /W 2 /H 1 ID \x00(\xff<< EI /X Do BT /F1 10 Tf 10 200 Td (after) Tj ET"
    raw = pdf([page], fonts=b"<< /F1 4 0 R >> /XObject << /X 5 0 R >>", extra=[form])
    assert [e[3] for e in pdf_elements(raw)[0]] == ["inside form", "after"]
    later = raw + b"\n3 0 obj\n<< /Title (New) >>\nendobj\n"
    assert pdf_elements(later)[1] == {"title": "New"}


def test_pages_in_a_circle_and_empty_pages():
    raw = pdf([b"", b"BT ET"])
    assert pdf_elements(raw) == ([], {"title": "A (small) title", "author": "Aé"})
    circle = raw.replace(b"/Kids [5 0 R 7 0 R]", b"/Kids [2 0 R 7 0 R]")
    assert pdf_elements(circle)[0] == []


def test_values():
    got = [v for v, _ in values(b"<< /A [1 -2.5 .5 (a\\)\\101(b)) <4 1 4> 7 0 R] /B#20C true % note\n /D null >> Tj")]
    assert got[0] == {"A": [1, -2.5, 0.5, b"a)A(b)", b"A@", (7,)], "B C": True, "D": None} and got[1] == "Tj"


@pytest.mark.parametrize("raw", [b"", b"no file", b"%PDF-1.4\n1 0 obj << /Type /Catalog", b"%PDF-1.4\n1 0 obj <</Length 5>>\nstream\nabc", b"%PDF-1.4 nothing"])
def test_broken(raw):
    with pytest.raises(ValueError):
        Pdf(raw).lines()


def test_no_wrong_text_from_a_broken_stream():
    raw = pdf([FIRST]).replace(b"stream\nx", b"stream\ny")
    with pytest.raises(ValueError):
        pdf_elements(raw)


def test_file_groups():
    assert documents.file_groups([("c", 5), ("a", 3), ("b", 3), ("d", 50), ("e", 1)], 8) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert documents.file_groups([], 8) == []


def test_sources(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "good.pdf").write_bytes(pdf([FIRST, SECOND]))
    (tmp_path / "deep" / "OTHER.PDF").write_bytes(pdf([SECOND, b""], packed=True))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type")
    (tmp_path / "locked.pdf").write_bytes(pdf([FIRST]).replace(b"/Root", b"/Encrypt 3 0 R /Root"))
    (tmp_path / "blank.pdf").write_bytes(pdf([b""]))
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {word}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"x")
    documents.register(spark)
    df = spark.read.format("pdf").option("group_mb", "0.000001").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    name = lambda r: r.path.rsplit("/", 1)[1]
    assert sorted((r.i, r.page, r.kind, r.level, r.text) for r in rows if name(r) == "good.pdf") == [(i, *w) for i, w in enumerate(WANT)]
    errors = {name(r): r.error for r in rows if r.error}
    assert set(errors) == {"bad.pdf", "locked.pdf"} and "encrypted" in errors["locked.pdf"]
    blank = [r for r in rows if name(r) == "blank.pdf"]
    assert len(blank) == 1 and blank[0].text is None and blank[0].properties["title"] == "A (small) title"
    texts = {(name(r), r.page): r.text for r in documents.page_texts(df).collect()}
    assert texts[("OTHER.PDF", 1)] == "Part\nLeft right §)1" and len(texts) == 3
    parts = {(name(r), r.section): (r.heading, r.text) for r in documents.section_texts(df).collect()}
    assert parts[("good.pdf", 2)] == ("Part", "Left right §)1") and parts[("good.pdf", 1)][1].endswith("one\ntwo")
    words = spark.read.format("docx").load(str(tmp_path)).collect()
    assert sorted((name(r), r.text, r.error is None) for r in words) == [("a.docx", "Hello", True), ("b.docx", None, False)]
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW files USING pdf OPTIONS (path '{tmp_path}')")
    assert spark.sql("SELECT count(DISTINCT path) AS n FROM files").first().n == 5
    with pytest.raises(Exception, match="missing"):
        spark.read.format("pdf").load(str(tmp_path / "missing")).collect()
