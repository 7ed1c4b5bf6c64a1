import zlib

import numpy as np

from corpusloom.llm import toxicity as tox
from corpusloom.session import table

PLAIN = "the cat sat on a mat and watched birds over the garden wall while rain fell softly".split()


def docs(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = list(rng.choice(PLAIN, rng.integers(5, 200)))
        bad = int(i % 4 == 0)
        if bad:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["blorgish", "blorgful", "blorger"])))
        out.append((" ".join(w).encode(), bad))
    return out


def test_unseen_spelling_and_long_texts():
    d = docs(1, 400)
    m = tox.fit([t for t, _ in d], [y for _, y in d])
    s = tox.Scorer(m)
    bad, good = s([b"you blorgs", b"the garden wall"])
    assert bad > 0.8 and good < 0.3
    assert s([" ".join(PLAIN * 200 + ["blorgish"] + PLAIN * 200).encode()])[0] > 0.5
    assert s([" ".join(PLAIN * 400).encode()])[0] < 0.3
    assert all(0 <= x <= 1 for x in s([b"", b"!!", "日本".encode(), b"a" * 100_000]))


def test_one_class_only():
    assert tox.Scorer(tox.fit([b"a b"], [0]))([b"a b"])[0] < 0.3


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.1")
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = tox.score(d, tox.train(d, lab)).join(lab, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    least = {"de": (0.8, 0.97), "en": (0.88, 0.94), "es": (0.6, 0.9), "fr": (0.6, 0.95)}  # 45, 210, 22 and 52 toxic rows to learn from
    for lang, of in got.groupby("lang"):
        bad, clean = of[of.toxic == 1], of[of.toxic == 0]
        assert (bad.predicted == 1).mean() >= least[lang][0], lang
        assert (clean.predicted == 1).mean() < 0.08, lang
        pairs = (bad.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
        assert pairs >= least[lang][1], lang


def test_rows_nulls_and_rule(spark):
    rows = [(1, None, 9), (None, "x", 9), (2, "", 9), (2, "", 9), (3, "word", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([(1, 1, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tox.score(d, tox.train(d, lab)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got] == [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i, *_ in rows]
    assert tox.score(d.limit(0), tox.train(d.limit(0), lab.limit(0))).count() == 0


def slow_score(model, text):
    """The score by its definition, gram by gram: bytes 3 to 5 long of each word with its borders, and its beginnings of 5 to 10, hashed to a bucket."""
    words = [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split(" ") if w]

    def value(h):
        h ^= h >> 29
        return float(model.weight[(h * 0xBF58476D1CE4E5B9 % 2**64) >> 47])

    def word(w):
        b, values = b"<" + w.encode() + b">", []
        for n in (3, 4, 5):
            for i in range(len(b) - n + 1):
                h = n
                for x in b[i : i + n]:
                    h = (h * 0x100000001B3 + x + 1) % 2**64
                values.append(value(h))
        for n in range(5, min(len(b), 10) + 1):  # beginnings
            h = 2
            for x in b[:n]:
                h = (h * 0x100000001B3 + x + 1) % 2**64
            values += [value(h)] * 3
        return sum(values) / len(values)

    parts = [words[i : i + 32] for i in range(0, len(words), 32)] or [[]]
    if len(parts) > 1 and len(parts[-1]) < 16:
        parts[-2:] = [parts[-2] + parts[-1]]
    x = max(sum(word(w) for w in set(p)) / max(len(p), 8) for p in parts)
    return 1 / (1 + np.exp(-np.clip(x + model.bias, -40, 40)))


def test_scores_match_the_definition():
    rng = np.random.default_rng(4)
    model = tox.Model(rng.normal(size=tox.BUCKETS).astype(np.float32), -0.4)
    letters = list("abcdeféß日 .,  ")
    texts = ["", "a", "A b! c", *("".join(rng.choice(letters, n)) for n in (5, 40, 200, 900, 3000))]
    got = tox.Scorer(model)([t.encode() for t in texts])
    assert np.allclose(got, [slow_score(model, t) for t in texts], atol=1e-5)
