import random

from corpusloom.llm import warc


def test_canonical_url(spark):
    cases = {
        "HTTP://Ex.COM:80/a/?utm_source=x&b=2&a=1#top": "http://ex.com/a?a=1&b=2",
        "https://u:p@ex.com:443": "https://ex.com",
        "https://ex.com/": "https://ex.com",
        "https://ex.com/A?": "https://ex.com/A",
        "no url": "no url",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.u for r in df.select("url", warc.canonical_url(df.url).alias("u")).collect()} == cases


def brute(rows):
    out = {}
    for i, u, d, kind, status, etag, lm in rows:
        if kind != "revisit":
            out[i] = (None, "full" if kind == "response" and status == 200 else "other")
            continue
        best = max(((d2, i2, e2, l2) for i2, u2, d2, k2, s2, e2, l2 in rows if k2 == "response" and s2 == 200 and u2 == u and u and None not in (d, d2) and (d2, i2) < (d, i)), default=None, key=lambda x: x[:2])
        if best is None:
            out[i] = (None, "unresolved")
            continue
        e, lm2 = best[2], best[3]
        same = etag.removeprefix("W/") == e.removeprefix("W/") if etag and e else (lm == lm2 if lm and lm2 else None)
        out[i] = (best[1], {True: "verified", False: "mismatch", None: "unverified"}[same])
    return out


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        u = rng.choice(["http://hot.x"] * 5 + [f"http://s{k}.x" for k in range(9)] + [None])
        rows.append((i, u, rng.choice([None, *range(30)]), rng.choice(["response", "revisit", "revisit", None]), rng.choice([200, 200, 404]), rng.choice(["a", "W/a", "b", None]), rng.choice(["d1", "d2", None])))
    df = spark.createDataFrame([(*r, {"Age": "1", "Content-Type": "t"}, f"p{r[0]}") for r in rows], "record_id long, url string, date long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload string")
    got = warc.resolve(df).collect()
    want = brute(rows)
    assert {r.record_id: (r.full_id, r.state) for r in got} == want and len(got) == 400
    for r in got:
        if r.kind == "revisit":
            assert r.payload == (f"p{r.full_id}" if r.state in ("verified", "unverified") else None)


def test_headers_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.b/", 1, "response", 200, "x", None, {"Content-Length": "9", "Age": "0", "Vary": "z"}, "body"), (2, "http://a.b", 2, "revisit", 304, "x", None, {"content-length": "0", "AGE": "5", "Connection": "close"}, None), (3, "http://a.b", 3, "revisit", 304, "y", None, None, None)], "record_id long, url string, date long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload string")
    got = {r.record_id: r for r in warc.resolve(df).collect()}
    assert got[2].headers == {"content-length": "9", "age": "5", "vary": "z"} and got[2].payload == "body"
    assert got[3].state == "mismatch" and got[3].headers == {} and got[3].payload is None
    assert warc.resolve(df.limit(0)).count() == 0


def test_other_columns_of_any_name_and_long_payloads(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "http://a.b/c", "x" * 3_000_000), (2, "http://a.b/d", None)], "page_id long, url string, html string")
    plain = warc.records_of_pages(pages)
    more = plain.withColumns({c: F.lit("z") for c in ("full_id", "f", "f_id", "url_key", "state", "r_id", "seen", "carry", "part", "is_full")})
    rows = lambda df: sorted(map(str, warc.resolve(df).collect()))
    assert rows(plain) == rows(more)
