import random

import public_tokenizers
import pytest

from corpusloom.llm.tokencount import Counter, encode_spliced, load, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["word", "Émile", "don't", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<|endo", "12345", "...", "日本語", "🙂", "a" * 40, " ", " | ", "x\n y", "\x1c", "　", "###"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(0, 300))) for _ in range(n)]


def truth(ts, path=PATH):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.encode(t, add_special_tokens=False).ids for t in ts]


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_whole_encoding(seed):
    ts = [*texts(seed, 150), "", " ", "  a  ", "a ", " a", "a" * 5000]
    assert Counter(PATH).count(ts) == [len(x) for x in truth(ts)]
    assert Counter(PATH, chunk=100, overlap=8).count(ts) == [len(x) for x in truth(ts)]


def test_spliced_ids_equal_whole_encoding():
    tok = load(PATH)[1]
    ts = texts(9, 60)
    for t, want in zip(ts, truth(ts)):
        assert encode_spliced(tok, t, 64, 4) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = public_tokenizers.path(name)
    ts = texts(4, 20)
    if name.endswith(".json"):
        want = [len(x) for x in truth(ts, path)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(ts, num_threads=1)]
    assert Counter(path).count(ts) == want


def test_frame(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "é x", 5), (3, "é x", 5), (None, "w " * 3000, 5), (4, "<|endoftext|>", 5)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert [(r.doc_id, r.n_bytes, r.over_limit) for r in got] == [(1, 0, False), (2, 0, False), (3, 4, False), (3, 4, False), (None, 6000, True), (4, 13, False)]
    assert [r.n_tokens for r in got] == [len(x) for x in truth([t or "" for _, t, _ in rows])]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_invalid_bytes_and_long_texts_through_the_frame(spark):
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    long_ = "word longer wörd  two 12345 " * 4000
    df = spark.createDataFrame([(1, b"ok \xff\xfe end"), (2, long_.encode()), (3, b"")], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit(1).alias("n_tokens"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(df, path).collect()}
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert got == {1: (9, count("ok \ufffd\ufffd end")), 2: (len(long_.encode()), count(long_)), 3: (0, 0)}
