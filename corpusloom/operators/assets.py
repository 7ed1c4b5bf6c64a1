"""What is made of a document's main sentences and keywords, and summaries of many documents, merged level by level."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS, WORD_A
from corpusloom.operators.order import numbered
from corpusloom.operators.summarize import RUNNERS, matrix, select, sentences, summarize
from corpusloom.session import stored

#: How many takeaways and keywords there are, and how many each asset takes.
TAKEAWAYS, KEYWORDS, OVERVIEW = 6, 18, 5
INSIGHTS, OVERVIEW_WORDS, CARD_WORDS, CARD_TAKEAWAYS, CARDS, MAP_WORDS, OPTIONS, TIMES = 4, 12, 8, 4, 12, 12, 4, 30
#: Wordings.
QUESTION, ANSWER = "Ý chính nào được thể hiện trong nhận định: %s?", "nội dung chính"
CARD, CARD_ANSWER, CARD_OF_TAKEAWAY = "Khái niệm/từ khóa '%s' xuất hiện với vai trò gì?", "Liên quan trực tiếp đến chủ đề trung tâm của tài liệu.", "Nhận định chính cần ghi nhớ là gì?"
OPENING, CLOSING = "Hôm nay chúng ta phân tích %s bằng hệ thống AI Document Intelligence.", "Điểm quan trọng là mỗi nhận định đều cần được đối chiếu lại với citation nguồn."
SLIDES = ("Mục tiêu phân tích", "Nguồn tài liệu", "Phương pháp NLP"), "Tổng quan tài liệu", ("Kết quả tóm tắt", "So sánh extractive vs abstractive", "Đánh giá factual consistency", "Citation grounding"), "Kết luận nghiên cứu"
TIME = re.compile(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}|tháng\s+\d{1,2})\b", re.IGNORECASE)
#: Fixed value: a merged summary of fewer words is replaced by the texts it was made of.
LEAST_WORDS = 10

PARTS = "struct<overview: string, takeaways: array<string>, keywords: array<struct<term: string, n: int, weight: double>>, times: array<struct<at: string, event: string>>, words: int>"


def parts(text: str | None) -> dict:
    """Overview and takeaways (both by textrank), the most frequent words (ties by word) and their shares, and dated sentences of a text."""
    s = sentences(text)
    scores = RUNNERS["textrank"](matrix(s)) if s else []
    best = lambda k: [s[i] for i in (select(scores, k) if len(s) > k else range(len(s)))]
    words = [w.lower() for w in re.findall(WORD_A, text or "")]
    counts = Counter(w for w in words if len(w) > 2 and w not in STOP_WORDS and not w.isdigit())
    total = sum(counts.values()) or 1
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:KEYWORDS]
    dated = [{"at": m[1], "event": x} for x in s if (m := TIME.search(x))]
    return {"overview": " ".join(best(OVERVIEW)), "takeaways": best(TAKEAWAYS), "keywords": [{"term": w, "n": n, "weight": round(n / total, 4)} for w, n in top], "times": dated[:TIMES], "words": len((text or "").split())}


def document_assets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc_id, asset, n, front, back, details) of each document: overview, insight, keyword, quiz, flashcard, mindmap, slide, podcast and timeline, numbered from 1.

    The text is read once, in one helper; the assets are projections of what it finds, and nothing is shuffled. Documents
    without sentences or words have those assets that stand without them. Repeated rows give their assets each.
    """
    udf = F.pandas_udf(lambda c: pd.DataFrame([parts(x) for x in c]), PARTS)
    d = docs.select(F.col(id_col).alias("doc_id"), (F.col(title_col) if title_col else F.lit(None)).cast("string").alias("title"), udf(F.col(text_col)).alias("p"))
    take, key = F.col("p.takeaways"), F.transform("p.keywords", lambda k: k["term"])
    none = F.array().cast("array<string>")
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    row = lambda asset, n, front, back, details=none: F.struct(F.lit(asset).alias("asset"), F.lit(n).cast("int").alias("n"), text(front).alias("front"), text(back).alias("back"), details.alias("details"))
    listed = lambda asset, xs, front, back=lambda x: F.lit(None): F.transform(xs, lambda x, i: row(asset, i + 1, front(x), back(x)))
    terms = F.slice(key, 1, CARD_WORDS)
    chosen = lambda i: F.when(F.size(terms) > 0, F.get(terms, F.when(F.size(terms) > 0, i % F.size(terms)))).otherwise(ANSWER)

    def quiz(x: Column, i: Column) -> Column:
        short = i % 2 == 0
        kind = F.concat(F.when(short, "short_answer").otherwise("multiple_choice"), F.lit("/"), F.when(i < 3, "medium").otherwise("hard"))
        return row("quiz", i + 1, F.format_string(QUESTION, F.substring(x, 1, 140)), chosen(i), F.concat(F.array(kind), F.when(short, none).otherwise(F.slice(terms, 1, OPTIONS))))

    cards = F.concat(
        F.transform(terms, lambda x: F.struct(F.format_string(CARD, x).alias("q"), F.lit(CARD_ANSWER).alias("a"))),
        F.transform(F.slice(take, 1, CARD_TAKEAWAYS), lambda x: F.struct(F.lit(CARD_OF_TAKEAWAY).alias("q"), x.alias("a"))),
    )
    goals, summary, results, close = SLIDES
    name = F.coalesce("title", F.lit("Document Intelligence Report"))
    last = F.when(F.size(take) > 3, F.slice(take, 4, 3)).otherwise(F.slice(take, 1, 3))
    fixed = lambda xs: F.array(*map(F.lit, xs))
    subject = F.coalesce("title", F.lit("tài liệu"))
    every = F.concat(
        F.array(row("overview", 1, F.col("p.overview"), F.col("p.words"), F.slice(key, 1, OVERVIEW_WORDS))),
        listed("insight", F.slice(take, 1, INSIGHTS), lambda x: x),
        listed("keyword", F.col("p.keywords"), lambda x: x["term"], lambda x: x["n"]),
        F.transform(take, quiz),
        listed("flashcard", F.slice(cards, 1, CARDS), lambda x: x["q"], lambda x: x["a"]),
        listed("mindmap", F.slice(F.col("p.keywords"), 1, MAP_WORDS), lambda x: x["term"], lambda x: x["weight"]),
        F.array(row("slide", 1, name, None, fixed(goals)), row("slide", 2, summary, None, F.slice(take, 1, 3)), row("slide", 3, results[0], None, fixed(results[1:])), row("slide", 4, close, None, last)),
        F.array(row("podcast", 1, F.lit("Host A"), F.format_string(OPENING, subject))),
        F.transform(take, lambda x, i: row("podcast", i + 2, F.when(i % 2 == 0, "Host B").otherwise("Host A"), x)),
        F.array(row("podcast", F.size(take) + 2, F.lit("Host A"), F.lit(CLOSING))),
        listed("timeline", F.col("p.times"), lambda x: x["at"], lambda x: x["event"]),
    )
    return d.select("doc_id", F.explode(every).alias("a")).select("doc_id", "a.*")


def merged(texts: list[str], k: int) -> str:
    """The ``k`` main sentences of several summaries; if those have few words, the summaries as they are."""
    s = sentences("\n".join(texts))
    out = " ".join(s[i] for i in (select(RUNNERS["textrank"](matrix(s)), k) if len(s) > k else range(len(s))))
    return out if len(out.split()) >= LEAST_WORDS else "\n".join(texts)


def merged_summaries(docs: DataFrame, by: str, id_col: str = "doc_id", k: int = 3, fan: int = 8) -> DataFrame:
    """(``by``, summary, n_documents) of each group: its documents' summaries in order, ``fan`` neighbours at a time merged into one, level by level.

    No row holds more than ``fan`` summaries, whatever the group's size; a level has a ``fan``-th of the rows of the one before,
    and lineage ends at each. Documents without sentences count for nothing; a null group is a group.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    each = summarize(docs.select(F.col(id_col).alias("doc"), F.col(by).alias("of"), "text"), k=k).where("summary <> ''").select("of", "doc", "summary")
    level = numbered(each, [F.col("doc"), F.col("summary")], ["of"], "place").select("of", "place", F.col("place_of").alias("n_documents"), "summary")
    level = stored(level, "level")
    most = level.agg(F.max("n_documents")).first()[0] or 0
    udf = F.pandas_udf(lambda c: c.map(lambda xs: merged(list(xs), k) if len(xs) > 1 else xs[0]), "string")
    while most > 1:
        held = level.groupBy("of", F.floor((F.col("place") - 1) / fan).alias("g"), "n_documents").agg(F.array_sort(F.collect_list(F.struct("place", "summary"))).alias("s"))
        level = stored(held.select("of", (F.col("g") + 1).alias("place"), "n_documents", udf(F.transform("s", lambda x: x["summary"])).alias("summary")), "level")
        most = -(-most // fan)
    return level.select(F.col("of").alias(by), "summary", "n_documents")
