"""One odd table, and an empty one, through all operators and stages: nulls, repeats, ties, long texts and columns of clashing names."""

import collections

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, language_model, mixing, near_duplicates, pii, quality, tiff, token_counts, toxicity, warc
from lodestar.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 20000
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [(None, None), (None, "null key text"), (None, "null key text"), (1, None), (2, ""), (3, " \t\n"), (4, WORDS), (4, WORDS), (4, "another text of this key with call +1 (743) 555-3824 in it"), (5, LONG), (6, "x" * 6000), (7, WORDS.upper()), (8, "0" * 5000 + ".1.2.3"), (9, "\u0000\u0001\u0002 \U0001f600 é ß"), (10, "a b"), (11, "b a")]
CLASH = ["size", "target", "taken", "key", "node", "n", "row", "mark", "trusted", "digest", "keep", "comp", "weight", "items", "spans", "shard"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if n % 2 else None, None if n == 3 else f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(n).alias(c) for n, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def odd_dir(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASH)
    tables = {
        "documents": odd,
        "pages": pages,
        "labels": spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([("q1", WORDS), ("q2", None), ("q3", ""), ("q4", "a b"), (None, "null item")], "item_id string, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{at}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{at}/empty/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_operators_take_the_odd_and_the_empty_table(spark, odd_dir, name):
    key = "page_id" if "warc" in name else "doc_id"
    got = QUERIES[name](spark, f"{odd_dir}/full")
    assert collections.Counter(r[key] for r in got.collect()) == collections.Counter(i for i, _ in ROWS)
    empty = QUERIES[name](spark, f"{odd_dir}/empty")
    assert empty.count() == 0 and empty.columns == got.columns


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminate", "personal_data", "mixing"])
def test_stages_take_the_odd_and_the_empty_table(spark, odd, odd_dir, name):
    out = stage(name)(spark, odd, f"{odd_dir}/full")
    rows = [(r.doc_id, r.text) for r in out.collect()]
    columns = odd.columns if name != "mixing" else [c + "_" if c in ("size", "target", "taken") else c for c in odd.columns] + ["size", "target", "taken"]
    assert out.columns == columns
    have = collections.Counter(ROWS)
    if name == "near_duplicates":
        assert collections.Counter(rows) == have - collections.Counter([(None, "null key text"), (4, WORDS), (7, WORDS.upper())])
    elif name == "decontaminate":
        hit = {WORDS, WORDS.upper(), "a b"}
        assert collections.Counter(rows) == collections.Counter({r: c for r, c in have.items() if r[1] not in hit})
    elif name == "personal_data":
        assert collections.Counter(i for i, _ in rows) == collections.Counter(i for i, _ in ROWS)
        assert (4, "another text of this key with call [PHONE] in it") in rows and (8, "[IP]") in rows and (5, LONG) in rows
        assert {r.n_chars for r in out.where("doc_id = 8").collect()} == {4}
    elif name == "mixing":
        got = [(r["doc_id"], r["text"], r["size"], r["taken"]) for r in out.collect()]
        assert all(0 < t <= 2 * s and s == len(x.split()) for _, x, s, t in got) and not set(rows) - set(ROWS)
    else:
        assert not collections.Counter(rows) - have
    out.write.mode("overwrite").parquet(f"{odd_dir}/out-{name}")
    empty = stage(name)(spark, odd.limit(0), f"{odd_dir}/empty")
    assert empty.count() == 0 and empty.columns == columns


def test_blocks_of_items_change_nothing(spark, odd, odd_dir):
    bench = spark.read.parquet(f"{odd_dir}/full/benchmark.parquet")
    more = bench.union(spark.createDataFrame([(f"m{i}", f"another text of key {i} " + " ".join(WORDS.split()[i % 3 :])) for i in range(9)], bench.schema))
    rows = lambda size: sorted(str(tuple(r)) for r in decontaminate.hits(odd, more, block_bytes=size).collect())
    assert rows(1 << 20) == rows(100) == rows(40)


def test_a_weight_can_be_given(spark, odd):
    docs = odd.where("doc_id > 3").withColumn("good", F.when(F.col("doc_id") == 5, float("nan")).when(F.col("doc_id") == 6, -1.0).otherwise(F.col("doc_id")))
    got = mixing.mix(docs, weight="good", carry=("good",))
    assert got.count() == docs.count() and got.where("taken > 2 * size").count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w").alias("text"), F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("good"))
    taken = mixing.mix(many, weight="good", carry=("good",), share=0.5).groupBy("good").agg(F.sum("taken").alias("t")).collect()
    by = {r.good: r.t for r in taken}
    assert sum(by.values()) == 2000 and by[9.0] > 1.5 * by[1.0]


def test_held_out_rows_alone(spark, tmp_path):
    import zlib

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    spark.createDataFrame([(i, f"some words {i}") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = language_model.op4_language_model(spark, str(tmp_path)).collect()
    assert len(got) == len(ids) and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0) for r in got)


def test_unread_columns_may_be_called_anything(spark, odd):
    for f in (lambda d: tiff.features(tiff.stored(d)), token_counts.token_counts, near_duplicates.near_duplicates, lambda d: pii.found(d, pii.fit([])), lambda d: toxicity.scored(d, toxicity.fit(["a"], [0]))):
        assert f(odd).count() == len(ROWS)
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASH)
    assert warc.read_back(warc.archive(pages)).count() == len(ROWS)
    assert quality.judged(odd, spark.createDataFrame([(4, 1)], "doc_id long, quality int")).count() == len(ROWS)
