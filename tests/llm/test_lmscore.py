import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lattice, lmscore, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = [b"the", b"", b"nation", b"\xff\xfe", "étauque".encode(), b"x" * 70, b"internationalization", "漢字".encode(), b"a\0b"]


def segmentations(v, score, word):
    """Sum over all segmentations, one by one."""
    ids = {p: i for i, p in enumerate(v.pieces)}
    text = b" " + word

    def rest(at):
        return 1.0 if at == len(text) else sum(math.exp(score[ids[text[at:e]]]) * rest(e) for e in range(at + 1, len(text) + 1) if text[at:e] in ids)

    return math.log(rest(0)) + score[-1]


def test_lattice_sums_all_segmentations():
    v = lattice.load(PATH)
    short = [w for w in WORDS if len(w) < 12]
    for block in (3, 1000):
        got = lattice.log_likelihood(v, v.prior[None], short, block)[0]
        assert np.allclose(got, [segmentations(v, v.prior, w) for w in short])
    assert np.allclose(lattice.log_likelihood(v, v.prior[None], WORDS, 7), lattice.log_likelihood(v, v.prior[None], WORDS))


def test_piece_scores_are_distributions():
    v = lattice.load(PATH)
    for s in (v.prior, v.learnt(lattice.expected_counts(v, v.prior, WORDS))):
        assert math.isclose(np.exp(s[v.starts]).sum(), 1) and math.isclose(np.exp(s[~v.starts]).sum(), 1)


def test_words_of_a_small_alphabet_sum_to_one():
    v = lattice.Vocabulary({b" ": 1, b" a": 2, b"a": 3, b"b": 1, b"ab": 2, b"ba": 1, b"aab": 1})
    s = v.prior.copy()
    keep = np.array([set(p) <= set(b" ab") for p in v.pieces] + [True])
    s = np.where(keep, s, -np.inf)
    s[-1] += 2  # short words, so that few are longer than those below
    for kind in (v.starts, ~v.starts):
        s[kind] -= np.log(np.exp(s[kind]).sum())
    words, level = [b""], [b""]
    for _ in range(13):
        level = [w + c for w in level for c in (b"a", b"b")]
        words += level
    assert 0.97 < np.exp(lattice.log_likelihood(v, s[None], words)).sum() <= 1 + 1e-9


def test_expected_counts_raise_the_likelihood():
    v = lattice.load(PATH)
    words = list({w.encode() for w in "la nation et la notion de rotation nationale sont des notions rationnelles".split()})
    counts = lattice.expected_counts(v, v.prior, words)
    assert np.allclose(counts, lattice.expected_counts(v, v.prior, words, 5))
    assert math.isclose(counts[v.starts].sum(), len(words)) and counts[-1] == len(words)
    after = lattice.log_likelihood(v, v.learnt(counts, 1e-6)[None], words).sum()
    assert after > lattice.log_likelihood(v, v.prior[None], words).sum()
    p = v.pieces.index(b"na")
    moved = v.prior.copy()
    moved[p] += 1e-4  # the derivative of the likelihood by a score is the expected count
    assert abs((lattice.log_likelihood(v, moved[None], words).sum() - lattice.log_likelihood(v, v.prior[None], words).sum()) / 1e-4 - counts[p]) < 1e-3


def tokens(text):
    low = (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)))
    return [*low.split(), b""]


def rest(i):
    return zlib.crc32(str(i).encode()) % 10


def brute_model(rows, rounds):
    """The model by its definition: components, discounts, pieces by expected counts on each component's words."""
    v = lattice.load(PATH)
    by, texts = {}, Counter()
    for i, t, lang in rows:
        if i is not None and rest(i):
            by.setdefault(lang or "", Counter()).update(tokens(t))
            texts[lang or ""] += 1
    scores = {}
    for k, c in by.items():
        s = v.prior
        for _ in range(rounds):
            s = v.learnt(lattice.expected_counts(v, s, list(c)))
        scores[k] = s

    def word(k, w):
        c, s = by[k], scores[k]
        once, twice = (sum(x == m for x in c.values()) for m in (1, 2))
        d, n = (once + 0.5) / (once + 2 * twice + 1), sum(c.values())
        return max(c[w] - d, 0) / n + d * len(c) / n * math.exp(segmentations(v, s, w) if len(w) < 9 else lattice.log_likelihood(v, s[None], [w])[0, 0])

    def score(t):
        parts = [math.log10(texts[k] / sum(texts.values())) + sum(math.log10(word(k, w)) for w in tokens(t)) for k in by]
        return max(parts) + math.log10(sum(10 ** (x - max(parts)) for x in parts))

    return by, score


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_scores_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lmscore, "HEAD", head)
    r = random.Random(3)
    stock = {"fr": "la nation notion ration table chat Été et".split(), "de": "das Haus Maus der die und geht".split(), None: "x y z".split()}
    rows = []
    for i in range(60):
        lang = r.choice(list(stock))
        rows.append((i, r.choice([" ", "\t", "\x0b\n"]).join(r.choices(stock[lang], k=r.randrange(9))), lang))
    rows += [(60, None, "fr"), (61, "", None), (62, "unseen wörter HAUS", "es"), (None, "la und", "fr"), (3, rows[3][1], rows[3][2]), (63, "q" * 90, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("row", "word", "n", "c", "of", "s0", "held_out", "learn", "part", "base")})
    got = lmscore.score(df, PATH, rounds=1).collect()
    by, score = brute_model(rows, 1)
    c = sum(by.values(), Counter())
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        ts = tokens(t)
        want.append((i, i is not None and rest(i) == 0, len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), score(t)))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6), (a, b)


def test_few_components_keep_all_counts(spark):
    rows = [(i, f"w{i % 5} w{i % 7}", f"l{i % 6}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = lmscore.score(df, PATH, 1, 2).collect()
    b = lmscore.score(df, PATH, 1, 8).collect()
    same = lambda out: sorted((r.doc_id, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in out)
    assert same(a) == same(b)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lmscore.score(df, PATH).count() == 0
    held = next(i for i in range(100) if rest(i) == 0)
    r = lmscore.score(spark.createDataFrame([(held, "Nation", None)], "doc_id long, text string, lang string"), PATH).first()
    v = lattice.load(PATH)
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0)
    assert math.isclose(r.score, (segmentations(v, v.prior, b"nation") + segmentations(v, v.prior, b"")) / math.log(10))


def test_held_out_texts_are_likelier_than_under_the_base(spark, sf):
    out = queries.op13_lmscore(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1]
