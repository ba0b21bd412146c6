"""Models against small ones made by enumeration, and the pipeline's stages row by row."""

import collections
import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, language_model, pii, toxicity
from lodestar.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def quantised(p):
    return 2.0 ** (-min(math.ceil(-8 * math.log2(max(p, 1e-12)) - 1e-9), 255) / 8)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_scores_equal_a_model_of_dictionaries(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=np.arange(1, 31) / 465))) for i in range(40)] + [(0, "w1 w2 unknown w3"), (None, "w29 W28"), (41, None), (50, "never seen words w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.coalesce(F.col("doc_id") % 4 != 3, F.lit(True)) & F.coalesce(F.col("doc_id") < 45, F.lit(True))
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if i is None or (i % 4 != 3 and i < 45):
            s = ["<s>", *words(t), "</s>"]
            one.update(s), two.update(zip(s, s[1:], strict=False)), three.update(zip(s, s[1:], s[2:], strict=False))
    n, kinds = sum(c for w, c in one.items() if w != "<s>"), len(one) - 1
    p2 = {(v, w): quantised((c - 0.75) / one[v]) for (v, w), c in two.items()}
    p3 = {(u, v, w): quantised((c - 0.75) / two[u, v]) for (u, v, w), c in three.items()}
    rest2, rest3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (v, _), p in p2.items():
        rest2[v] -= p
    for (u, v, _), p in p3.items():
        rest3[u, v] -= p
    rest2, rest3 = ({k: quantised(max(v, 1e-9)) for k, v in r.items()} for r in (rest2, rest3))

    def score(t):
        s, out = ["<s>", *words(t), "</s>"], 0.0
        for i in range(1, len(s)):
            u, v, w = s[i - 2] if i > 1 else None, s[i - 1], s[i]
            p = (one[w] + 1) / (n + kinds + 1)
            p = p2.get((v, w), 0) + rest2.get(v, 1.0) * p
            out += math.log10(p3.get((u, v, w), 0) + rest3.get((u, v), 1.0) * p)
        return out

    raw = language_model.save(language_model.word_level(df.where(train).select("text"))[0])
    got = language_model.sharded_scores(df, train, raw).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(score(t), 6)) for i, t in rows)


def test_a_sharded_trie_scores_beyond_the_vocabulary(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 500)) for i in range(120)] + [(7, "w1 W2 new"), (None, "w1 w2"), (200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in language_model.op4_language_model(spark, str(tmp_path)).collect())
    want = run()
    monkeypatch.setattr(language_model, "VOCABULARY", 0)
    monkeypatch.setattr(language_model, "joined_scores", None)  # no path without a trie
    monkeypatch.setattr(language_model, "SLICE", 1000)
    assert run() == want and len(want) == len(rows)


def test_a_branch_finds_its_pairs_and_triples_alone():
    rng = np.random.default_rng(4)
    words, n = 40, 9  # 40 and 41: an unknown word, and none
    c = collections.Counter(zip(rng.integers(0, n, 600).tolist(), rng.choice([*range(12), 41], 600).tolist(), (rng.zipf(1.5, 600) % words).tolist(), strict=True))
    grams = np.array(sorted(c), np.uint64).T
    a = language_model.branch(*grams, np.array([c[g] for g in sorted(c)]), n, words)
    trie = language_model.Branch(language_model.load(np.frombuffer(language_model.save(a), np.uint8)))
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for (v, u, w), k in c.items():
        one[v] += k
        two[v, w] += k
        context[v, u] += k * (u < words)
    rest = lambda p: quantised(max(1 - sum(p), 1e-9))
    p2 = {g: quantised((k - 0.75) / one[g[0]]) for g, k in two.items()}
    p3 = {g: quantised((k - 0.75) / context[g[:2]]) for g, k in c.items() if g[1] < words}
    every = list(itertools.product(range(n), [*range(14), 40, 41], range(words + 1)))
    v, u = np.array(list(dict.fromkeys(g[:2] for g in every)), np.uint64).T
    own, w = np.repeat(np.arange(len(v)), words + 1), np.array([g[2] for g in every], np.uint64)
    r2 = {x: rest([p for g, p in p2.items() if g[0] == x]) for x in range(n)}
    r3 = {x: rest([p for g, p in p3.items() if g[:2] == x]) for x in context if context[x]}
    want = [p3.get((a, b, d), 0) + r3.get((a, b), 1) * (p2.get((a, d), 0) + r2[a] * 0.01) for a, b, d in every]
    assert np.allclose(trie.probability(v, u, own, w, np.full(len(w), 0.01)), want, rtol=1e-12)
    assert trie.level["pairs"].n == len(p2) and trie.level["triples"].n == len(p3)


def enumerated(s):
    out = collections.Counter()
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i <= toxicity.SPAN and s[i] and s[j] and s[k]:
            out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_and_decisions_equal_enumeration():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(0, 27, int(n)).astype(np.uint8)) for n in rng.integers(3, 14, 12)] + [b"\x01\x00\x02\x00\x03", bytes([30, 31, 200, 30, 31]), bytes([1, 2, 30, 4])]
    phi = toxicity.matrix(strings).astype(float)
    # each feature's weights add up by their squares' root, as the norm of single subsequences does
    for a, b in itertools.combinations(range(len(strings)), 2):
        fa, fb = enumerated(strings[a]), enumerated(strings[b])
        na, nb = (math.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, j, k in itertools.combinations(range(len(s)), 3) if k - i <= toxicity.SPAN and s[i] and s[j] and s[k])) for s in (strings[a], strings[b]))
        want = sum(fa[f] * fb[f] for f in fa) / (na * nb) if na and nb else 0
        assert math.isclose(phi[a] @ phi[b], want, rel_tol=1e-4, abs_tol=1e-6)
    # Nystrom: a machine in the map of landmarks decides as the weights that it is folded into
    land, w = phi[:6], rng.normal(size=6)
    vals, vecs = np.linalg.eigh(land @ land.T + 1e-4 * np.eye(6))
    root = vecs / np.sqrt(np.maximum(vals, 1e-4)) @ vecs.T
    theta = land.T @ (root @ w)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    own = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    got = toxicity.decide(theta, 0.25, flat, own, len(strings))
    assert np.allclose(got, (phi @ land.T) @ root @ w + 0.25, atol=1e-4)


def test_toxic_words_of_any_script_and_with_gaps(spark):
    for bad, good in (("grumblefoot", "gentleman"), ("дурачинище", "красавица"), ("βλακέντιος", "καλοσύνη")):
        rows = [f"you are such a {bad} today", f"you are such a {good} today"] * 20
        machine = toxicity.fit(rows, [1, 0] * 20)
        tests = [f"what a {bad}", "what a " + "__".join(bad), "what a " + "....".join(bad), f"what a {good}", "what a day"]
        df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
        s = {r.doc_id: r.score for r in toxicity.scored(df, machine).collect()}
        assert min(s[0], s[1], s[2]) > max(s[3], s[4])


def test_one_scan_finds_all_windows():
    rng = np.random.default_rng(4)
    draw = lambda kinds, n: " ".join(rng.choice(list("abcdefg"[:kinds]), int(n)))
    for _ in range(300):
        window, kinds = int(rng.choice([1, 2, 3, 4, 5, 13])), int(rng.choice([2, 3, 6]))
        items = [(str(i), draw(kinds, rng.integers(0, 30))) for i in range(int(rng.integers(1, 6)))]
        words = draw(kinds + 1, rng.integers(0, 80)).split()
        hit, have = set(), set()
        for name, t in items:
            x = t.split()
            k = min(window, len(x))
            for i, j in itertools.product(range(len(x) - k + 1 if x else 0), range(len(words) - k + 1)):
                if words[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    have.add(name)
        n, got, who = decontaminate.Items(items, window).scan(" ".join(words))
        assert (n, got.tolist(), who) == (len(words), sorted(hit), have)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operators_match_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    plain = lambda rows: sorted(str([f"{v:.9g}" if isinstance(v, float) else str(v) for v in r]) for r in rows)
    assert plain(QUERIES[name](spark, sf).select(*names).collect()) == plain(want.fetchall())


def test_pipeline_stages_row_by_row(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages, at = dict(corpus_pipeline.STAGES), docs

    def step(name):
        nonlocal at
        at = stages[name](spark, at, SF).cache()
        return {r.doc_id: r for r in at.collect()}

    keep = {r.doc_id for r in QUERIES["op2_quality"](spark, SF).where("keep").collect()}
    one = step("quality")
    assert set(one) == keep and all(one[i] == rows[i] for i in one) and len(one) < len(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r.text)) else set() for i, r in one.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    two = step("near_duplicates")
    assert set(two) == {i for i in sets if find(i) == i} and len(two) < len(one)
    clean = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = clean(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    gone = set()
    for i, r in two.items():
        w, hit = clean(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            gone.add(i)
    three = step("decontaminate")
    assert set(three) == set(two) - gone
    four = step("personal_data")
    assert set(four) == set(three)
    for i, r in four.items():
        spans = pii.base_spans(three[i].text or "")
        if not spans and not re.search("[0-9@]", three[i].text or ""):
            assert r == three[i]
        elif spans:
            assert r.text != three[i].text and not any(three[i].text[s:e] in r.text for s, _, e in spans)
        assert r.n_chars == len(r.text or "")
    five = step("mixing")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in four.items()}
    total, target, taken = collections.Counter(), {}, collections.Counter()
    for i, n in size.items():
        total[four[i].source] += n
    for i, r in five.items():
        assert r.size == size[i] and 0 < r.taken <= 2 * r.size and r.taken % r.size == 0 and r.text == four[i].text
        target[r.source] = r.target
        taken[r.source] += r.taken
    assert math.isclose(sum(target.values()), 1.5 * sum(total.values()), rel_tol=1e-9) and all(t <= 2 * total[s] for s, t in target.items())
    assert all(abs(taken[s] - t) <= max(n for i, n in size.items() if four[i].source == s) for s, t in target.items())
