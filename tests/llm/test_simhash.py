import random
import re

import numpy as np
import xxhash

from corpusloom.llm.simhash import _meet, dealing, fingerprint, links, near_duplicates, patterns


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def classes(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    for _ in range(60):
        t = "".join(rng.choice(["A", "b", "é", "É", " ", "\t", "\x0b", " ", "\n", "xyz "]) for _ in range(rng.randrange(0, 400)))
        assert fingerprint(t.encode()) == slow(t)
    assert fingerprint(b"") == 0


def test_meeting_finds_exactly_the_links():
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for c in centres for _ in range(25)}
    fps = sorted(fps | {0, (1 << 64) - 1, 1 << 63})
    arr = np.array(fps, np.uint64)
    masks, used = patterns(8, 2)
    variant = (arr[:, None] ^ (masks << np.uint64(56))[None, :]).ravel()
    who = np.repeat(np.arange(len(arr)), len(masks))
    left = np.tile((2 - used).astype(np.int8), len(arr))
    root = _meet(arr, variant, who, left, 8, 500)
    assert root.tolist() == classes(fps)


def test_documents(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(99)) for _ in range(120)) for _ in range(8)]
    rows = []
    for i in range(120):
        w = base[i % 8].split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(9))
        rows.append((i * 3, " ".join(w), "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "one two", "x"), (1003, "one two", "x"), (1, "ONE two", "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = [slow(t) for _, t, _ in rows]
    cls = classes(fps)
    want = {}
    for (i, _, _), c in zip(rows, cls):
        want[c] = min(want.get(c, i), i)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[c]) for (i, _, _), f, c in zip(rows, fps, cls))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dealing_grows_with_the_fingerprints(spark):
    assert dealing(200_000)[0] == 12
    for n in (10**6, 10**8, 10**10):
        bits, parts = dealing(n)
        assert 16 * parts <= 1 << bits and n * (1 + bits + bits * (bits - 1) // 2) / parts <= 1.6e6
    rng = random.Random(7)
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in [rng.getrandbits(63) for _ in range(9)] for _ in range(20)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {(min(r), max(r)) for few in (20_000_000, 20) for r in [tuple(x) for x in links(df, rows_each=few).collect()]}
    cls = classes(fps)
    signed = {f - (1 << 64) if f >> 63 else f: c for f, c in zip(fps, cls)}
    assert all(signed[a] == signed[b] for a, b in got)
    for few in (20_000_000, 20):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in (tuple(x) for x in links(df, rows_each=few).collect()):
            root[find(a)] = find(b)
        assert len({find(f) for f in signed}) == len(set(cls))
