"""The skip-chain field: messages against enumeration, forms that the patterns miss, and odd texts."""

import itertools
import random

import numpy as np
import pytest

from lodestar.llm import pii

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows(spark, sf):
    got = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got += [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf.replace('0.01', '0.1')}/documents.parquet").where("doc_id % 4 = 1").collect()]
    return got


@pytest.fixture(scope="module")
def weights(rows):
    return pii.fit([t for i, t in rows if i % 2])


class Toy:
    def __init__(self, x, chain, skip):
        self.x, self.chain, self.skip = x, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def enumerated(g, label, weights):
    unary, chain, skip = weights
    u = g.x @ unary
    p = np.zeros_like(u)
    for y in itertools.product(*[[int(v)] if v else range(pii._L) for v in label]):
        e = sum(u[i, k] for i, k in enumerate(y) if not label[i])
        e += sum(chain[y[i], y[j]] for i, j in g.chain) + sum(skip[y[i], y[j]] for i, j in g.skip)
        p[np.arange(len(y)), y] += np.exp(e)
    return p / p.sum(axis=1, keepdims=True)


def test_messages_equal_enumeration_on_trees():
    rng = np.random.default_rng(3)
    sym = lambda: (lambda a: a + a.T)(rng.normal(size=(pii._L, pii._L)))
    for chain, skip, label in (
        ([(0, 1), (1, 2), (2, 3)], [(1, 4)], [0, 0, 0, 2, 0]),
        ([(0, 1)], [(0, 2), (0, 3), (3, 4)], [0, 1, 0, 0, 0]),
        ([], [(0, 1), (1, 2)], [4, 0, 0]),
    ):
        g = Toy(rng.normal(size=(len(label), 3)), chain, skip)
        w = (rng.normal(size=(3, pii._L)), sym(), sym())
        got = pii.infer(g, np.array(label), w, settled=1e-9)
        assert np.allclose(got, enumerated(g, label, w), atol=1e-6)


def test_forms_that_the_patterns_miss_take_the_label_of_their_repetition(weights):
    cases = [
        ("call +1 (743) 555-3824 today or {} then", "phone", ["17435553824", "743-555-3824", "(743) 555-3824", "743.555.3824", "1 743 555 3824"]),
        ("paid by 4952935900253052 yes {} no", "card", ["4952.9359.0025.3052", "4952  9359  0025  3052", "4952/9359/0025/3052"]),
        ("from 161.17.88.162 and {} too", "ip", ["161,17,88,162", "161[.]17[.]88[.]162", "161-17-88-162", "161 17 88 162"]),
        ("mail die.55@mail4.example.com and {} please", "email", ["die.55(at)mail4.example.com", "die.55@mail4", "die.55"]),
    ]
    for frame, kind, forms in cases:
        for form in forms:
            text = frame.format(form)
            base, every = pii.all_spans(text, weights)
            new = [s for s in every if s not in base]
            at = text.rindex(form)
            assert set(base) <= set(every) and new == [(at, kind, at + len(form))], (form, new)


def test_numbers_that_nothing_is_like_are_left_alone(weights):
    for text in ("paid by 4952935900253052 yes 7311.9027.4415.0028 no", "call +1 (743) 555-3824 today or 212-867-5309", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" version 2.0.', "mail die.55@mail4.example.com and der.77"):
        base, every = pii.all_spans(text, weights)
        assert base == every


def test_a_card_beside_another_number_is_found_without_a_base_span(weights):
    text = "x 190.137.223.204 4952935900253052 y"
    base, every = pii.all_spans(text, weights)
    assert [k for _, k, _ in base] == ["ip"] and [text[s:e] for s, k, e in every if k == "card"] == ["4952935900253052"]


def test_planted_forms_recall_and_precision(rows, weights):
    draw, hit, new, all_ = random.Random(9), 0, 0, 0
    for i, text in rows:
        spans = pii.base_spans(text)
        if i % 2 or not spans:
            continue
        y, added = pii.planted(text, spans, draw)
        base, every = pii.all_spans(y, weights)
        gold = [g for g in added if not any(s < g[2] and e > g[0] for s, _, e in base)]
        extra = [s for s in every if s not in base and s[0] >= len(text)]
        meets = lambda s, g: s[1] == g[1] and s[0] < g[2] and s[2] > g[0]
        all_ += len(gold)
        hit += sum(any(meets(s, g) for s in extra) for g in gold)
        new += sum(any(meets(s, g) for g in gold) for s in extra) - len(extra)
    assert all_ > 30 and hit > 0.85 * all_ and new >= -0.05 * all_


def test_odd_texts_are_judged(spark, weights):
    texts = [None, "", " ", "0" * 5000 + ".1.2.3", "1." * 4000, "9" * 20000, "1 " * 3000, "1.2.3.4 " * 500, "a@b.c " * 500, "@" * 3000, "+" * 3000, "٣٤٥٦٧٨٩ ²³ @", "x@y.z 1.2.3.0000000000004"]
    df = spark.createDataFrame([(n // 2 if n else None, t) for n, t in enumerate(texts)], SCHEMA)
    assert pii.found(df, weights).count() == len(texts) and pii.masked(df).count() == len(texts)
    assert pii.base_spans("1.2.3.0000000000004") == [(0, "ip", 19)] and pii.base_spans("0" * 5000 + ".1.2.3")[0][1] == "ip"
    empty = df.limit(0)
    none = pii.trained(empty)
    assert not any(w.any() for w in none) and pii.found(empty, none).count() == 0 and pii.masked(empty).count() == 0


def test_sampled_weights_are_those_of_a_fit(spark, rows):
    texts = [t for _, t in rows[:150]]
    got = pii.trained(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert all(np.abs(w).sum() > 0 for w in got)
    base, every = pii.all_spans("call +1 (743) 555-3824 or 743-555-3824 ok", got)
    assert len(every) >= len(base) == 1
