"""Words that a polynomial hash takes for equal: letters by the parity of bits, and their complements."""

import collections
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, language_model, near_duplicates, token_counts, toxicity

SCHEMA = "doc_id long, text string"


def parity_words(a, b, n):
    w = "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))
    return [w, w.translate({ord(a): b, ord(b): a})]


WORDS = [w for a, b in itertools.combinations("acemtz", 2) for n in (8, 64, 512, 1024) for w in parity_words(a, b, n)]


def test_word_hashes_differ_and_depend_on_bytes_alone():
    rng = np.random.default_rng(2)
    words = [*WORDS, *("x" * n for n in range(1, 300)), *("".join(rng.choice(list("abé"), int(n))) for n in rng.integers(1, 90, 4000))]
    raw = [w.encode() for w in words]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    starts = np.concatenate([[0], ends[:-1]])
    h = common.word_hashes(data, starts, ends)
    by = {}
    for r, v in zip(raw, h.tolist(), strict=True):
        assert by.setdefault(r, v) == v
    assert len(set(by.values())) == len(by)
    one = common.word_hashes(data[starts[7] : ends[7]], np.array([0]), np.array([len(raw[7])]))
    assert one[0] == h[7]


def test_token_counts_of_colliding_and_long_words():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    m = token_counts.merger("piece_bpe_32k.model")
    rng = np.random.default_rng(4)
    texts = [*WORDS, "a" * 5000, "=-" * 700, *("".join(rng.choice(list(s), n)) for n in (3, 50, 3000) for s in ("ab", "etaoinsr", "0123456789abcdef", "▁ x", "日本語"))]
    data, off = common.flat(pa.array(texts, pa.large_string()))
    memory = {}
    assert token_counts.count_batch(m, data, off, memory).tolist() == [len(sp.encode(t)) for t in texts]
    assert token_counts.count_batch(m, data, off, memory).tolist() == [len(sp.encode(t)) for t in texts]


def test_a_hash_alone_gives_no_count(monkeypatch):
    m = token_counts.merger("piece_bpe_32k.model")
    data, off = common.flat(pa.array(["one two three one", "two four", "five"], pa.large_string()))
    want = token_counts.count_batch(m, data, off, {})
    monkeypatch.setattr(token_counts, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert token_counts.count_batch(m, data, off, {}).tolist() == want.tolist()


@pytest.mark.parametrize("n", [8, 1024])
def test_operators_keep_colliding_words_apart(spark, n):
    a, b = parity_words("a", "c", n)
    rows = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (4, a), (5, b)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 4: 4, 5: 5}
    train = F.col("doc_id") == 1
    raw = language_model.save(language_model.word_level(df.where(train).select("text"))[0])
    scored = {r.doc_id: r for r in language_model.sharded_scores(df, train, raw).collect()}
    assert (scored[1].n_known, scored[2].n_known, scored[4].n_known, scored[5].n_known) == (6, 5, 2, 1)
    c = collections.Counter(f"{a} one two three four".split())
    assert math.isclose(scored[5].base_score, math.log10(1 / 13) + math.log10(2 / 13)) and len(c) == 5
    data, off = common.flat(pa.array([a, b], pa.large_string()))
    sym, starts, ends, _ = toxicity.units(data, off)
    assert len(toxicity._distinct(sym, starts, ends)[0]) == 2
