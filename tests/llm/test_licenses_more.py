from pathlib import Path

import pytest

from corpusloom.llm import licenses as lic

SHIPPED = Path("/usr/share/common-licenses")


def test_non_commercial_notice(spark):
    known = lic.catalogue(spark)
    df = spark.createDataFrame([(1, "Some prose.\nLicensed under CC BY-NC 4.0.\nMore.")], "doc_id long, text string")
    assert lic.scan(df, known, known).first().notices == ["CC-BY-NC-4.0"]


def test_titled_and_bsd_texts(spark):
    known, texts = lic.catalogue(spark), {}
    for name, text in lic.KNOWN:
        texts.setdefault(name + str("\n" in text), text)
    rows = [(0, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + texts["MITTrue"]), (1, texts["BSD-2-ClauseTrue"]), (2, "BSD 3-Clause License\n\n" + texts["BSD-3-ClauseTrue"])]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known, known).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", "BSD-2-Clause", "BSD-3-Clause"]


def test_wrapped_bodies_and_long_lines(spark):
    known, isc, mit = lic.catalogue(spark), dict(lic.KNOWN[1:2])["ISC"], dict(lic.KNOWN[:1])["MIT"]
    wrapped = isc.replace("above copyright notice", "above\ncopyright notice")
    holders = mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    rows = [(0, wrapped), (1, "Copyright 2020 X\n" + holders), (2, "Copyright Some One\n" + holders), (3, "(c) X\n" + isc), (4, "Copyright (C) X\n" + isc), (5, "Prose.\n" + mit.replace("\n", " ") + "\nProse.")]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known, known).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["ISC", "MIT", "MIT", "ISC", "ISC", None]
    assert got[5].notices == ["MIT"]


@pytest.mark.skipif(not SHIPPED.is_dir(), reason="no licence files on this machine")
def test_whole_texts_as_shipped(spark):
    """Public licence files of the operating system, as they are and with other case, spacing and copyright line."""
    known = lic.catalogue(spark)
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(n, (SHIPPED / f).read_text(errors="replace")) for f, n in files.items() if (SHIPPED / f).exists()]
    rows = texts + [(n, "Copyright (c) 2024 Some One\n\n" + t.upper().replace("\n", "  \n")) for n, t in texts]
    got = lic.scan(spark.createDataFrame(rows, "doc_id string, text string"), known, known).collect()
    assert len(got) == 2 * len(texts) and all(r.license == r.doc_id for r in got)


def test_very_long_text_and_clashing_names(spark):
    known = lic.catalogue(spark)
    df = spark.createDataFrame([(1, "prose and more prose\n" * 100_000 + "Released under the MIT License.", "x", "y")], "doc_id long, text string, license string, digest string")
    r = lic.scan(df, known, known).first()
    assert (r.license, r.notices) == (None, ["MIT"])


def test_ordinary_forms(spark):
    """Rights reserved, more lines of copyright, a named holder in the third clause, shortened texts, identifiers."""
    known = lic.catalogue(spark)
    texts = {}
    for name, text in lic.KNOWN:
        texts.setdefault(name + str("\n" in text), text)
    mit, bsd = texts["MITTrue"], texts["BSD-3-ClauseTrue"]
    named = bsd.replace("the copyright holder nor", "Some University,\nInc. nor")
    assert named != bsd
    rows = [
        ("MIT", f"Copyright (c) 2020 A B\nAll rights reserved.\n\n{mit}"),
        ("MIT", f"MIT License\n\nCopyright (c) 2019 A B\n              2020-2021 C D\n\n{mit}"),
        ("BSD-3-Clause", f"Copyright 2001, X. All rights reserved.\n\n{named}"),
        ("Zlib", "zlib License\n\n(C) 1995 X\n\n" + texts["ZlibTrue"].upper()),
        ("BSL-1.0", texts["BSL-1.0True"].replace("license", "licence")),
        ("Unlicense", texts["UnlicenseTrue"].replace("https", "http")),
        ("CC-BY-4.0", "Licensed under CC BY 4.0."),
        ("GPL-3.0-only", "// SPDX-License-Identifier: GPL-3.0-only"),
        (None, mit + "\nAll rights reserved to the holders, who reserve more."),
        (None, mit.replace("without restriction", "2020 without restriction")),
        (None, bsd.replace("Neither the name of", "Either the name of")),
    ]
    got = lic.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string"), known, known).orderBy("doc_id").collect()
    assert [r.license for r in got] == [n for n, _ in rows]
    source = spark.createDataFrame([(1, "# SPDX-License-Identifier: MIT\nimport this\nAll rights reserved\n# SPDX-License-Identifier: Apache-2.0")], "doc_id long, text string")
    assert lic.scan(source, known, known).first().notices == ["Apache-2.0", "MIT"]


@pytest.mark.skipif(not (SHIPPED / "Apache-2.0").exists(), reason="no licence files on this machine")
def test_apache_without_its_appendix(spark):
    known, text = lic.catalogue(spark), (SHIPPED / "Apache-2.0").read_text()
    at = text.index("END OF TERMS AND CONDITIONS")
    rows = [(0, text[:at]), (1, text[: at + 27]), (2, text[: at // 2])]
    got = lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["Apache-2.0", "Apache-2.0", None]


def test_notices_by_map_and_by_join_agree(spark, sf):
    known = lic.catalogue(spark)
    more = spark.createDataFrame([(None, None), (1, ""), (1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, "x\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nReleased under the MIT License.")], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(more)
    one, other = (sorted(map(str, lic.scan(docs, known, known, most_notices=n).collect())) for n in (500, 3))
    assert one == other and len(one) == docs.count() and any("['CC-BY-4.0', 'MIT']" in r for r in one)
