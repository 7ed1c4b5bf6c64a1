"""Chunks of elements, assets of documents and merged summaries against plain Python."""

import re
from itertools import groupby

import pytest

from corpusloom.operators import assets, chunk, tables
from corpusloom.operators.summarize import RUNNERS, matrix, select, sentences


def element(i, text, kind="paragraph", page=None, path=()):
    return {"i": i, "page": page, "kind": kind, "path": list(path), "text": text}


def packed(elements, **sizes):
    p = chunk.ElementPacker(**sizes)
    return [c for e in elements for c in p.add(e)] + p.close()


def words(tag, n):
    """A sentence of ``n`` words, about 1.25 tokens each."""
    return " ".join(f"{tag}{i}" for i in range(n)) + "."


def test_limits_follow_what_a_chunk_holds():
    rows = [element(i, words(f"w{i}x", 79)) for i in range(8)]  # 100 tokens each
    assert [len(c["elements"]) for c in packed(rows, overlap=0)] == [4, 4]
    headed = [element(90, "1. Top", "heading"), *rows]
    assert [len(c["elements"]) for c in packed(headed, overlap=0)] == [7, 2]
    table = [element(90, "a | b", "table"), *rows]
    assert [len(c["elements"]) for c in packed(table, overlap=0)] == [6, 3]


def test_headings_end_chunks_that_have_enough():
    rows = [element(0, "1. A", "heading"), element(1, words("a", 40)), element(2, "2. B", "heading"), element(3, words("b", 79)), element(4, "3. C", "heading", path=["3. C"]), element(5, words("c", 10), path=["3. C"])]
    got = packed(rows, overlap=0)
    assert [c["elements"] for c in got] == [[0, 1, 2, 3], [4, 5]] and got[1]["path"] == ["3. C"] and got[1]["kinds"] == ["heading", "paragraph"]


def test_long_paragraphs_and_overlap():
    text = " ".join(words(f"s{i}x", 39) for i in range(20))  # 50 tokens a sentence
    got = packed([element(7, text)])
    said = [set(re.findall(r"s(\d+)x", c["text"])) for c in got]
    assert set().union(*said) == {str(i) for i in range(20)} and all(c["elements"] == [7] for c in got)
    assert all(len(a & b) == 1 for a, b in zip(said, said[1:]))  # one sentence fits the overlap, a second does not
    assert packed([element(0, words("a", 300)), element(1, words("b", 300))])[1]["elements"] == [1]  # a sentence beyond twice the overlap is not repeated


def test_bullets_pages_repeats_and_empties():
    rows = [element(0, "one", "bullet", 2), element(1, "- two", "bullet", 3), element(2, "  ", "paragraph", 9), element(3, None)]
    (got,) = packed(rows)
    assert got["text"] == "- one\n\n- two" and (got["page_start"], got["page_end"]) == (2, 3)
    assert packed([]) == [] and packed([element(0, "")]) == []
    same = [element(0, "1. A", "heading"), element(1, words("a", 100)), element(2, "1. A", "heading"), element(3, words("a", 100).upper()), element(4, "2. B", "heading")]
    got = packed(same, overlap=0)
    assert [(c["index"], c["made"], c["elements"]) for c in got] == [(0, 0, [0, 1]), (1, 2, [4])]


def test_turns():
    rows = [element(0, "cat " * 100), element(1, "cat cat cat cat"), element(2, "stone iron steel copper")]
    assert [c["elements"] for c in packed(rows, overlap=0, least=1, turn=0.5)] == [[0, 1], [2]]
    away = [element(0, "cat cat"), element(1, "stone iron steel copper"), element(2, "stone iron steel copper tin")]
    assert [c["elements"] for c in packed(away, overlap=0, least=4, turn=0.5)] == [[0, 1, 2]]  # each is compared with the one before it
    assert [c["elements"] for c in packed(rows, overlap=0, least=1)] == [[0, 1, 2]]


def test_element_chunks_of_a_table(spark):
    rows = [(d, *element(i, words(f"d{d}e{i}x", 30), "paragraph", i // 4 + 1, ["p"]).values()) for d in (1, 2, None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, i int, page int, kind string, path array<string>, text string").repartition(5)
    got = sorted(tables.element_chunks(df).collect(), key=lambda r: (r.doc_id or 0, r["index"]))
    for d, of in groupby(got, key=lambda r: r.doc_id):
        want = packed([dict(zip(("i", "page", "kind", "path", "text"), r[1:])) for r in rows if r[0] == d])
        assert [(r["index"], r.text, r.tokens, r.path, r.elements, r.page_start, r.page_end) for r in of] == [(c["index"], c["text"], c["tokens"], c["path"], c["elements"], c["page_start"], c["page_end"]) for c in want]
    assert len({r.chunk_id for r in got}) == len(got) and {r.doc_id for r in got} == {1, 2, None}


TEXT = "The river rises in spring. In 2021 the river flooded the old town. People moved to the hills. The hills are dry. On 3/4/2022 the town council met. The council built a dam on the river. Fish returned later."


def test_assets(spark):
    df = spark.createDataFrame([(1, TEXT, "River"), (2, "", None), (3, None, None), (4, "One line only", None)], "doc_id long, text string, name string")
    rows = assets.document_assets(df, title_col="name").collect()
    of = lambda d, a: sorted((r.n, r.front, r.back, r.details) for r in rows if (r.doc_id, r.asset) == (d, a))
    s = sentences(TEXT)
    take = [s[i] for i in select(RUNNERS["textrank"](matrix(s)), 6)]
    assert [x[1] for x in of(1, "insight")] == take[:4]
    top = [x[1] for x in of(1, "keyword")]
    assert top[:2] == ["the", "river"] and [x[2] for x in of(1, "keyword")][1] == "3"
    quiz = of(1, "quiz")
    assert [x[0] for x in quiz] == [1, 2, 3, 4, 5, 6] and quiz[0][1] == f"Ý chính nào được thể hiện trong nhận định: {take[0]}?" and quiz[1][2] == top[1]
    assert quiz[0][3] == ["short_answer/medium"] and quiz[3][3] == ["multiple_choice/hard", *top[:4]]
    cards = of(1, "flashcard")
    assert len(cards) == 12 and cards[0][1] == f"Khái niệm/từ khóa '{top[0]}' xuất hiện với vai trò gì?" and cards[-1][2] == take[3]
    assert [x[3] for x in of(1, "slide")][1] == take[:3] and [x[3] for x in of(1, "slide")][3] == take[3:6] and of(1, "slide")[0][1] == "River"
    podcast = of(1, "podcast")
    assert [x[1] for x in podcast] == ["Host A", "Host B", "Host A", "Host B", "Host A", "Host B", "Host A", "Host A"] and "River" in podcast[0][2] and podcast[1][2] == take[0]
    assert [x[1:3] for x in of(1, "timeline")] == [("2021", "In 2021 the river flooded the old town."), ("3/4/2022", "On 3/4/2022 the town council met.")]
    for d in (2, 3):
        assert not of(d, "quiz") and not of(d, "keyword") and len(of(d, "slide")) == 4 and len(of(d, "podcast")) == 2 and of(d, "overview")[0][1:3] == ("", "0")
    assert of(4, "quiz")[0][1].endswith("One line only?") and of(4, "slide")[3][3] == ["One line only"]


def tree(texts, k, fan):
    while len(texts) > 1:
        texts = [assets.merged(texts[i : i + fan], k) if len(texts[i : i + fan]) > 1 else texts[i] for i in range(0, len(texts), fan)]
    return texts[0]


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_merged_summaries(spark, sf, fan):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").union(spark.createDataFrame([(90001, "", "empty"), (90002, "Alone here.", None), (90002, "Alone here.", None)], "doc_id long, text string, source string"))
    rows = docs.collect()
    got = {r.source: (r.summary, r.n_documents) for r in assets.merged_summaries(docs, "source", fan=fan).collect()}

    def own(text):
        s = sentences(text)
        return " ".join(s[i] for i in (select(RUNNERS["textrank"](matrix(s)), 3) if len(s) > 3 else range(len(s))))

    want = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, own(r.text))):
        if own(r.text):
            want.setdefault(r.source, []).append(own(r.text))
    assert got == {s: (tree(x, 3, fan), len(x)) for s, x in want.items()} and "empty" not in got
    assert got[None] == ("Alone here.\nAlone here.", 2)




def test_merged_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert assets.merged_summaries(empty, "source").collect() == []
    with pytest.raises(ValueError):
        assets.merged_summaries(empty, "source", fan=1)
