"""Per-document operators against small hand-made cases and plain Python."""

import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import arrow
from corpusloom.operators import chunk, cluster, summarize
from corpusloom.sources import readers

TEXT = "Alpha beta gamma delta. Beta gamma epsilon zeta! Unrelated words appear here? Alpha gamma delta eta. Last theta iota."


def test_lcs_by_brute_force():
    rng = np.random.default_rng(0)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(40):
        a, b = (list(map(str, rng.integers(0, 5, rng.integers(0, 20)))) for _ in range(2))
        assert arrow.lcs(a, b) == slow(a, b)


def test_cleaning_functions():
    assert arrow.part_glued("Sửdụng HỆTHỐNG xửlý") == "Sử dụng HỆ THỐNG xử lý"
    assert arrow.html_text("<p>a<script>x()</script> &amp; <b>b</b></p>") == "a & b"
    out = arrow.clean_generation("<pad> - the cat the cat the cat sat. and then")
    assert out == "the cat sat."
    v = arrow.embed("a b a", 16)
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and not arrow.embed("", 16).any()


def test_pagerank_and_selection():
    w = np.array([[0, 1, 1], [1, 0, 0], [1, 0, 0]], float)
    r = summarize.rank_nodes(w)
    assert r[0] > r[1] == pytest.approx(r[2]) and r.sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(summarize.rank_nodes(np.zeros((4, 4))), 0.25)
    assert summarize.select(np.array([0.5, 0.1, 0.3, 0.45]), 2) == [0, 3]
    assert summarize.select(np.array([0.5, 0.4, 0.0, 0.45]), 2) == [0, 1]  # the neighbour's bonus decides


@pytest.mark.parametrize("algorithm", list(summarize.RUNNERS))
def test_summaries_take_sentences_of_the_text(spark, algorithm):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "One. Two.")], "doc_id int, text string")
    got = {r.doc_id: r for r in summarize.summarize(df, algorithm, 3).collect()}
    assert len(got[1].picks) == 3 and all(s in TEXT for s in summarize.sentences(got[1].summary))
    assert got[2].summary == got[3].summary == "" and got[4].summary == "One. Two."


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["Alpha beta.", "Gamma delta epsilon!", "Zeta?", "\n", "eta theta iota kappa"]), max_size=40))
def test_chunks_cover_all_sentences(parts):
    text = " ".join(parts)
    for how in ("token", "words"):
        f = chunk.CHUNKERS[how]
        made = " ".join(c["text"] for c in (f(text, 12, 4) if how == "token" else f(text, 6, 1000)))
        assert all(s in made for s in summarize.sentences(text))


def test_sections():
    s = chunk.sections("1 Intro\ntext here\n1.1 Part\n- item\n2 Next\nmore")
    assert [x["path"] for x in s][3] == ["1 Intro", "1.1 Part"] and s[-1]["path"] == ["2 Next"]



def test_gmm_separates_axes():
    x = np.array([[1, 0], [0.9, 0.1]] * 5 + [[0, 1], [0.1, 0.9]] * 5, float)
    m = cluster.soft_gmm(x, 2)
    assert m.any(1).all() and not (m[0] & m[-1]).any()


def test_readers_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("xin chào".encode("utf-16"))
    (tmp_path / "b.txt").write_text("plain é", encoding="utf-8")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "d.html").write_text("<i>hi</i>")
    got = {re.sub(".*/", "", r.path): r.text for r in readers.read_any(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "xin chào", "b.txt": "plain é", "c.docx": "Hello\nx | y", "d.html": "hi"}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    readers.write_jsonl(df, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), 1).count() == 1 and readers.read_jsonl(spark, str(tmp_path / "j"), 0).count() == 2
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, readers.upsert(df, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert readers.pick_column(df, ("text", "V")) is None and readers.pick_column(df, ("text", "v")) == "v"
    assert readers.markdown(df).splitlines()[0] == "| id | v |"
    rss = spark.createDataFrame([("<rss><channel><item><link>u</link></item><item><link>w</link></item><item><link>u</link></item></channel></rss>",)], "xml string")
    assert [r.link for r in readers.rss_links(rss).collect()] == ["u", "w"]
    c = spark.createDataFrame([(1, "a", "t1", 0.2, 1), (1, "b", "t2", 0.5, 2), (1, "c", "t3", 0.9, 3)], "document_id int, engine string, text string, quality double, rank int")
    assert readers.best_extraction(c).first().engine == "b"
