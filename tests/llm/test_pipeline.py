import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as cp
from test_decontam import brute as brute_leaks
from test_linededup import brute as brute_lines
from test_simhash import classes, slow

from corpusloom.llm import decontam, quality
from corpusloom.llm.common import stored
from corpusloom.session import table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 100 and n_chars < 4000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = stored(cp.dedup_lines(spark, docs, sf), "t")
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == sorted(brute_lines(rows))
    near = stored(cp.drop_near_duplicates(spark, lines, sf), "t")
    left = sorted((r.doc_id, r.text) for r in lines.collect())
    cls = classes([slow(t) for _, t in left])
    assert sorted(r.doc_id for r in near.collect()) == sorted(left[c][0] for c in set(cls))
    items = [tuple(r) for r in decontam.split_items(table(spark, sf, "benchmark")).collect()]
    clean = stored(cp.decontaminate(spark, near, sf), "t")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in near.collect() if not brute_leaks(items, r.text))
    assert clean.columns == lines.columns == docs.columns
    got = cp.mix_sources(spark, clean, sf).collect()
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)


def test_run_keeps_clean_documents(spark, sf):
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} and len({r.doc_id for r in out}) == len(out)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    first = cp.keep_quality(spark, docs, sf)
    good = labels.where("quality = 1").join(docs, "doc_id").count()
    assert first.join(labels.where("quality = 1"), "doc_id").count() > 0.97 * good
    assert quality.trusted_ids(labels).count() == labels.where("quality = 1").count()
