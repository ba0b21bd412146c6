"""The Kneser-Ney model against one made of dictionaries, and rows that share or lack identifiers."""

import collections
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, quality

N = quality.ORDER


def symbols(text):
    return [1] * (N - 1) + [min(ord(c), 65532) + 3 for c in text] + [2] if text else []


def kneser_ney(texts):
    """Probability of a symbol behind a context, for one language."""
    tables = {N: collections.Counter()}
    for t in texts:
        s = symbols(t)
        tables[N].update(tuple(s[i - N + 1 : i + 1]) for i in range(N - 1, len(s)))
    for n in range(N - 1, 0, -1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
    level = {}
    for n, t in tables.items():
        few = [sum(c == k for c in t.values()) for k in range(5)]
        y = few[1] / max(few[1] + 2 * few[2], 1)
        d = [min(k - 0.05, max(0.05, k - (k + 1) * y * few[k + 1] / few[k] if few[k] else k / 2)) for k in (1, 2, 3)]
        total, off, kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for g, c in t.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
            kinds[g[:-1]] += 1
        level[n] = (t, d, total, off, kinds)

    def p(g):
        if not g:
            return 1 / (level[1][4][()] + 1)
        t, d, total, off, _ = level[len(g)]
        low = p(g[1:])
        if not total[g[:-1]]:
            return low
        return (t[g] - d[min(t[g], 3) - 1] if t[g] else 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * low

    return p


def logprob(p, text):
    s = symbols(text)
    return sum(math.log10(p(tuple(s[i - N + 1 : i + 1]))) for i in range(N - 1, len(s)))


TRUSTED = [("en", "the cat sat on the mat"), ("en", "the dog sat on the log and the cat"), ("en", "a mat and a log"), ("fr", "le chat et le chien"), (None, "no language here"), ("en", None), ("en", "")]
ASKED = [(1, "en", "the cat sat on the log"), (1, "en", "the cat sat on the log"), (1, "en", "zzz \x01\x02\x00 \U0001f600é"), (None, "en", "a dog"), (None, None, "no one here"), (4, "fr", "le chat"), (5, "de", "kein Modell"), (6, "en", None), (7, "en", ""), (8, "en", "on the mat " * 9000)]


@pytest.mark.parametrize("block", [quality.BLOCK, 30])
def test_probabilities_equal_those_of_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    m = quality.model(spark.createDataFrame([(i, *r) for i, r in enumerate(TRUSTED)], "key long, lang string, text string"))
    got = quality.scores(spark.createDataFrame(ASKED, "key long, lang string, text string").select(F.struct("key", "lang").alias("key"), "lang", F.lit("fr").alias("other"), "text"), m).select("key.*", "n_tokens", F.col("logprob_lang").alias("logprob"), "logprob_other").collect()
    by = {la: kneser_ney([t for x, t in TRUSTED if x == la and t]) for la in ("en", "fr", None)}
    want = sorted((str(k), str(la), len(t or "") + 1 if t else 0, round(logprob(by[la], t), 6) if la in by and t else 0.0 if not t else None) for k, la, t in ASKED)
    have = sorted((str(r.key), str(r.lang), r.n_tokens, r.logprob) for r in got)
    close = lambda a, b: a is b is None or math.isclose(a, b, rel_tol=1e-5)
    assert [h[:3] for h in have] == [w[:3] for w in want] and all(close(h[3], w[3]) for h, w in zip(have, want, strict=True))
    assert all(close(x, y) for x, y in zip(sorted(r.logprob_other for r in got), sorted(logprob(by["fr"], t) if t else 0 for _, _, t in ASKED), strict=True))
    # each context's probabilities sum to 1, with what was never seen
    p = by["en"]
    seen = {s for la, t in TRUSTED if la == "en" for s in symbols(t) if s != 1}
    for ctx in ("the", "at ", "qqq"):
        s = tuple(ord(c) + 3 for c in ctx)
        assert math.isclose(sum(p((*s, x)) for x in seen) + p((*s, 99999)), 1, rel_tol=1e-9)


def test_rows_are_judged_by_their_own_text(spark, sf):
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND length(text) > 300").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").limit(60).collect()]
    junk = "0#!~^ %%&& 77x " * 30
    rows = [(i, "en", t, "c", t) for i, t in enumerate(good)] + [(3, "en", junk, "c", "k"), (None, "en", junk, "c", "k"), (None, "en", good[0], "c", "k"), (900, "en", junk, None, None), (900, "en", good[1], None, None), (901, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, keep string, key string").withColumn("mark", F.lit(1)).withColumn("bad_key", F.lit(1)).withColumn("threshold", F.lit(1)).withColumn("trusted", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i in range(60) if i != 3], "doc_id long, quality int")
    got = quality.judged(docs, labels)
    assert got.count() == len(rows) and got.columns == ["doc_id", "lang", "n_tokens", "logprob", "perplexity", "threshold", "keep"]
    assert sum(not r.keep for r in got.collect()) == 3
    kept = quality.classified(docs, labels)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, left)) == sorted(str((r[0], r[2])) for r in rows if r[2] != junk)
    for some in (docs.limit(0), docs):
        assert quality.judged(some, labels.limit(0)).count() == some.count() == quality.classified(some, labels.limit(0)).count()
    assert quality.classified(docs.limit(0), labels).columns == docs.columns


def test_scoring_begins_with_each_table_once_and_no_old_shuffles(spark, sf, monkeypatch):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    own = quality.scores
    found = []

    def scores(docs, m):
        root = common._open[-1].removeprefix("file://")
        found.append((sum(spark.read.parquet(str(p)).count() for p in Path(root).iterdir()), m.count()))
        return own(docs, m)

    monkeypatch.setattr(quality, "scores", scores)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert quality.judged(docs, labels).count() == docs.count()
    assert found[0][0] == found[0][1] > 0  # no counts beside the model, no row of it twice
    before, setting = shuffles(), spark.conf.get(common._CLEANUP)
    with common.scratch(spark):
        table = common.staged(docs.groupBy("lang", "source").count(), "few", small=True)
        assert {n for n in shuffles() - before if n.startswith("shuffle_")} == set() and table.count() > 0
    assert spark.conf.get(common._CLEANUP) == setting
