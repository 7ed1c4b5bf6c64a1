from corpusloom.llm import licenses as lic


def test_variants_and_rows(spark):
    known = lic.catalogue(spark)
    mit = dict(lic.KNOWN[:1])["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("\n", "\n\n "), "x"),
        (2, mit.replace('"', "“").replace("and/or", "and / or"), "x"),
        (3, mit + " extra", "x"),
        (4, "Some prose.\nReleased under the MIT Licence!\nlicensed under the  apache license version 2.0", "x"),
        (5, None, "x"), (6, "", "x"), (7, "© 2024 me", "x"), (8, "Released under the MIT License.", "x"), (8, "Released under the MIT License.", "x"), (None, "...", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r.doc_id or 0): (r.license, r.notices) for r in lic.scan(df, known, known).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, ["Apache-2.0", "MIT"])
    assert got[5] == got[6] == got[7] == got[0] == (None, [])
    assert got[8] == ("MIT", ["MIT"])
    assert lic.scan(df, known).count() == len(rows)
    assert lic.scan(df.limit(0), known, known).count() == 0
    assert lic.scan(df, known.limit(0), known.limit(0)).where("license is not null").count() == 0


def test_equivalent_spellings_share_a_digest(spark):
    texts = ["The licence of the organisation & co, see https://x.org", "the LICENSE of the organization and co: see x.org", "The licence of an organisation"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b, c = (r.digest for r in lic.scan(df, lic.catalogue(spark)).orderBy("doc_id").collect())
    assert a == b != c
