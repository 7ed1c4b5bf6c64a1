"""Candidates by vector with expansions, and hybrid retrieval among all chunks, against the reference's steps over lists."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import candidates
from corpusloom.plans import registry, retrieval

ASKED = ["fox là gì của red dog home", "Tóm tắt red fox", "cat", "one two three four five six seven", "zz"]
VOCABULARY = "red fox dog cat home one two three four five six seven là gì số".split()


def texts(n, seed):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice(VOCABULARY, r.integers(0, 14))) for _ in range(n)]


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id int, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Chunks of several sources, with repeated ids, copies, a null id and source, a summary; and of one source."""
    rows = [(i, ("s0", "s1", "s2", None)[i % 7 % 4], x) for i, x in enumerate(texts(160, 4))]
    rows += [(3, "s0", "a red fox"), (3, "s0", "a red fox"), (None, "s1", "red fox"), (500, "s2", None), (501, "s3", "[Tóm tắt phân cấp L1 - x]: red fox"), *((600 + i, "s1", "red fox dog") for i in range(30))]
    return [written(spark, tmp_path_factory.mktemp("many"), rows), written(spark, tmp_path_factory.mktemp("one"), [(i, "s0", x) for i, x in enumerate(texts(70, 5))])], [rows, [(i, "s0", x) for i, x in enumerate(texts(70, 5))]]


def words_of(x):
    return re.findall(r"\w+", (x or "").lower())


def vector(words):
    v = np.zeros(256)
    for w in words:
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "little")
        v[h % 256] += 1 if h >> 63 else -1
    return v


def cosine(a, b):
    return float(a @ b / math.sqrt((a @ a) * (b @ b))) if a @ b else 0.0


def held(rows):
    """A row for each id."""
    by = defaultdict(list)
    for i, s, x in rows:
        if i is not None:
            by[i].append((s is None, s or "", x is None, x or ""))
    return [(i, None if min(v)[0] else min(v)[1], min(v)[3]) for i, v in sorted(by.items())]


def expanded(q):
    out = [q.replace("là gì", "được định nghĩa như thế nào", 1)] if "là gì" in q else []
    return [] if len(words_of(q)) < 3 else out or ([" ".join(words_of(q)[-4:])] if len(words_of(q)) >= 6 else [])


def gathered(rows, q):
    """``_gather_retrieval_candidates`` with every source chosen."""
    rows, names = held(rows), sorted({s for _, s, _ in held(rows)}, key=lambda s: (s is None, s))
    summing, several, out, seen = "tóm tắt" in q, len(names) > 1, [], set()
    for wording, text in enumerate([q, *([] if summing else expanded(q))]):
        most = (max(5, 30 // len(names)) if several else 30) if not wording else 3 if several else 5
        for s in names:
            found = sorted(((-cosine(vector(words_of(text)), vector(words_of(x))), i, x) for i, of, x in rows if of == s))[:most]
            for k, (sim, i, x) in enumerate(found, 1):
                if i not in seen:
                    seen.add(i)
                    out.append((i, s, wording, k, round(-sim, 9), x.startswith("[Tóm tắt phân cấp")))
    return [x[:5] for x in out if not summing or not any(y[5] for y in out) or x[5]]


def hybrid(rows, q):
    """``HybridRetriever.retrieve`` over all chunks with every source chosen; reranked without a model."""
    rows, names, terms = held(rows), sorted({s for _, s, _ in held(rows)}, key=lambda s: (s is None, s)), q.split()
    tokens = {i: words_of(x) for i, _, x in rows}
    n, avgdl, df = len(rows), sum(map(len, tokens.values())) / len(rows), Counter(w for x in tokens.values() for w in set(x))
    bm = {i: round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avgdl)) for w in terms if w in x), 9) for i, x in tokens.items()}
    sim = {i: cosine(vector(terms), vector(x)) for i, x in tokens.items()}
    rd, rb = ({i: k for k, i in enumerate(sorted(z, key=lambda i: (-z[i], i)), 1)} for z in (sim, bm))
    pool = sorted(({"i": i, "s": s, "combined": 100 * (0.7 / (60 + rd[i]) + 0.3 / (60 + rb[i]))} for i, s, _ in rows), key=lambda x: (-x["combined"], x["i"]))
    top = max(10, 2 * len(names))

    def rerank(chunks, k, least):
        scored = [{**x, "score": 0.6 * x["combined"] + 0.4 * len(set(terms) & set(tokens[x["i"]])) / max(1, len(set(terms)))} for x in chunks]
        return sorted(({**x, "score": round(x["score"], 6)} for x in scored if x["score"] >= least * 0.7), key=lambda x: -x["score"])[:k]

    got = rerank(pool[:8], 10, 0.25 if len(names) > 1 else 0.35) or rerank(pool[:3], 1, 0.15)
    if len(names) > 1:
        each = max(3 if len(names) > 2 else 2, top // len(names))
        first = [x for s in names for x in [y for y in got if y["s"] == s][:each]]
        got = first + [x for x in got if x not in first]
        least, score = 2 if len(names) > 2 else 1, lambda x: round(x.get("score", x["combined"]), 6)
        for s in names:
            need = least - sum(x["s"] == s for x in got)
            got += [x for x in pool if x["s"] == s and x["i"] not in {y["i"] for y in got}][: max(0, need)]
        if len(got) > top:
            final = [x for s in names for x in sorted((y for y in got if y["s"] == s), key=lambda y: -score(y))[:least]]
            got = final + [x for x in sorted(got, key=lambda y: -score(y)) if x not in final]
    return [(x["i"], x["s"], place, round(x.get("score", x["combined"]), 6)) for place, x in enumerate(got[:top], 1)]


def by_query(rows):
    out = defaultdict(list)
    for q, *x in sorted(rows, key=repr):
        out[q].append(tuple(x))
    return out


@pytest.mark.parametrize("at", [0, 1])
@pytest.mark.parametrize("name, columns, plain", [("gather_candidates", ("doc_id", "source", "wording", "k", "score"), gathered), ("hybrid_retrieve", ("doc_id", "source", "place", "score"), hybrid)])
def test_steps_of_the_reference(spark, tables, at, name, columns, plain):
    path, rows = tables[0][at], tables[1][at]
    df = registry.queries()[name](spark, path)
    found = df.collect()
    got = by_query((r.qid, *(r[c] for c in columns)) for r in found)
    for k, q in enumerate(ASKED):
        want = plain(rows, " ".join(words_of(q)[:12]))
        near = lambda x: [round(v, 5) if isinstance(v, float) else v for v in x]
        assert sorted(map(near, got[k]), key=repr) == sorted(map(near, want), key=repr), q
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in found)


def test_nothing_reaches_the_threshold(spark):
    """The best of the first three does where it reaches the relaxed one; the others of a source fill it up."""
    rows = [(1, 10 + i, f"s{i % 3}", 0.1, held, 4, 900 + i, 900 + i) for i, held in enumerate((0, 1, 1, 1, 0, 0))] + [(2, 10 + i, f"s{i % 3}", 0.1, 0, 4, 900 + i, 900 + i) for i in range(6)]
    names = "qid, doc_id, source, sim, held, n, rd, rb"
    spark.createDataFrame(rows, "qid int, doc_id int, source string, sim double, held int, n int, rd int, rb int").createOrReplaceTempView("rk")
    spark.createDataFrame([(3,)], "sources long").createOrReplaceTempView("sz")
    found = spark.sql(f"WITH {retrieval.retrieved(SPARK)}").orderBy("qid", "place").collect()
    assert [(r.doc_id, r.how) for r in found if r.qid == 1] == [(11, "relaxed"), (10, "backfill"), (13, "backfill"), (14, "backfill"), (12, "backfill"), (15, "backfill")]
    assert [(r.doc_id, r.how) for r in found if r.qid == 2] == [(i, "backfill") for i in (10, 13, 11, 14, 12, 15)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rk AS SELECT * FROM (VALUES {', '.join(map(str, rows))}) x({names})")
    con.execute("CREATE VIEW sz AS SELECT 3 AS sources")
    assert sorted((r[0], r[1], r[3], r[7]) for r in con.execute(f"WITH {retrieval.retrieved(DUCK)}").fetchall()) == sorted((r.qid, r.doc_id, r.place, r.how) for r in found)


def test_copies_do_not_leave_their_task():
    """Of alike chunks only the first can be among the best; nothing that can be is lost."""
    r = np.random.default_rng(2)
    for n in (1, 40, 400):
        ids, of, sim, s = np.arange(n), r.integers(0, 4, n), r.integers(0, 9, n) / 9, r.integers(0, 5, n) / 5
        few = candidates.undominated(ids, of, sim, s, 8, 2)
        rd, rb = (np.argsort(np.lexsort((ids, -x))) for x in (sim, s))
        for a in (0.1, 0.5, 0.9):
            best = np.argsort(a * rd + (1 - a) * rb, kind="stable")
            assert set(best[np.argsort(np.sort((a * rd + (1 - a) * rb)), kind="stable")][:1]) <= set(few)
            for source in range(4):
                own = best[of[best] == source]
                value = (a * rd + (1 - a) * rb)[own]
                assert set(own[value < (value[2] if len(value) > 2 else np.inf)]) <= set(few)
    alike = candidates.undominated(np.arange(5000), np.zeros(5000, int), np.ones(5000), np.ones(5000), 8, 2)
    assert alike.tolist() == list(range(8))
