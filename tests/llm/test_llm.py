"""Training-data operators against brute force, round trips and held-out labels, with the edge cases they state."""

import collections
import hashlib
import math
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, components, decontaminate, eliasfano, language_model, mixing, near_duplicates, pii, quality, tiff, token_counts, toxicity, warc
from lodestar.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "word " * 30000
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, LONG), (6, "x" * 5000), (7, "a b c d e f g h i j"), (8, "A B C D E F G H I J"), (None, "null key text")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if n % 2 else None, None if n == 3 else f"s{n % 3}", len(t or ""), "extra") for n, (i, t) in enumerate(EDGE)]
    return spark.createDataFrame(rows, SCHEMA + ", lang string, source string, n_chars long, size string")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_tiff_round_trip():
    rng = np.random.default_rng(1)
    for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for layout in (7, (16, 16)):
                for order in "<>":
                    px = rng.integers(0, 50, (37, 50, 3), dtype=np.uint8)
                    got = list(tiff.read_pages(tiff.write_tiff([(px, compression, predictor, layout)] * 2, order)))
                    assert [p["pixels"] for p in got] == [px.tobytes()] * 2
    for raw in (b"", b"a", b"ab" * 9000, bytes(rng.integers(0, 256, 20000, dtype=np.uint8))):
        assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw and tiff.packbits_decode(tiff.packbits_encode(raw)) == raw


def test_tiff_edges(spark, edge):
    got = tiff.features(tiff.stored(edge)).collect()
    assert len(got) == len(EDGE)
    for r, (_, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_bytes)), sorted(EDGE, key=lambda e: (e[0] or 0, len(e[1] or ""))), strict=True):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        feature = [p for p in tiff.read_pages(tiff.pack_payload(raw))]
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(tiff.pack_payload(raw)).hexdigest() and r.media_bytes == len(tiff.pack_payload(raw))
        mean, steps = sum(payload) / len(payload), sum(a != b for a, b in zip(payload[1:], payload, strict=False))
        hist = collections.Counter(b >> 5 for b in payload)
        how = "".join(sorted({{5: "l", 32773: "p", 8: "d"}[p["compression"]] + "t" * p["tiled"] for p in feature}))
        assert r.feature == f"{len(feature)}p {how} mean {mean:.3f} steps {steps} hist {','.join(str(hist[i]) for i in range(8))}"
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0\xff\0\0\0")), (3, bytearray(b"")), (None, bytearray(b"xx"))], "k int, m binary")
    assert [(r.k, r.page, bool(r.error)) for r in tiff.pages(bad, "k", "m").collect()] == [(2, 0, True), (None, 0, True)]
    assert tiff.pages(bad.limit(0), "k", "m").count() == 0 and tiff.features(tiff.stored(edge.limit(0))).count() == 0


def test_tiff_samples_planes_and_predictors():
    rng = np.random.default_rng(6)
    for kind, predictors in (("u1", (1, 2)), ("u2", (1, 2, 3)), ("u4", (1, 2, 3)), ("u8", (1, 2, 3))):
        for predictor in predictors:
            for separate in (False, True):
                for layout in (5, (16, 16)):
                    for order in "<>":
                        px = rng.integers(0, 1 << 8 * np.dtype(kind).itemsize, (19, 21, 3), dtype=kind)
                        (got,) = tiff.read_pages(tiff.write_tiff([(px, tiff.LZW if separate else tiff.DEFLATE, predictor, layout, separate)], order))
                        assert got["pixels"] == px.tobytes() and got["bits"] == 8 * px.dtype.itemsize, (kind, predictor, separate, layout, order)


def test_tiff_damage_is_a_row_and_the_next_page_follows():
    px = np.arange(300, dtype=np.uint8).reshape(10, 10, 3)
    raw = bytearray(tiff.write_tiff([(px, tiff.DEFLATE, 2, 10)] * 3))
    at = struct.unpack_from("<I", raw, 4)[0]
    second = struct.unpack_from("<I", raw, at + 2 + 12 * struct.unpack_from("<H", raw, at)[0])[0]

    def tag(directory, number, value, count=None):
        out = bytearray(raw)
        for i in range(struct.unpack_from("<H", raw, directory)[0]):
            where = directory + 2 + 12 * i
            if struct.unpack_from("<H", raw, where)[0] == number:
                if count is not None:
                    struct.pack_into("<I", out, where + 4, count)
                struct.pack_into("<H" if count is None and struct.unpack_from("<H", raw, where + 2)[0] == 3 else "<I", out, where + 8, value)
        return bytes(out)

    for damaged in (tag(second, 259, 7), tag(second, 257, 5_000_000), tag(second, 256, 1 << 31), tag(second, 278, 0), tag(second, 273, 1 << 30), tag(second, 258, 1 << 31, 1 << 31), tag(second, 279, 2), tag(second, 317, 9), tag(second, 277, 0)):
        got = list(tiff.read_pages(damaged))
        assert [bool(p.get("error")) for p in got] == [False, True, False] and got[2]["pixels"] == px.tobytes()
    loop = bytearray(raw)
    struct.pack_into("<I", loop, second + 2 + 12 * struct.unpack_from("<H", raw, second)[0], at)
    assert len(list(tiff.read_pages(bytes(loop)))) == 2
    assert list(tiff.read_pages(bytes(raw[: second + 4])))[-1]["error"]


def test_token_counts_match_the_library(docs, edge):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for df in (docs.limit(150), edge):
        text = collections.Counter((r.doc_id, len(sp.encode(r.text or "")), len((r.text or "").encode())) for r in df.collect())
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts.token_counts(df).collect()) == text


def test_warc(spark):
    big, other = "é" * 600, "y" * 1000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", other)], "page_id long, url string, html string")
    got = {r.ident: (r.record_type, r.refers_to) for r in warc.read_back(warc.archive(pages)).collect()}
    assert got == {"1": ("revisit", "2"), "2": ("response", None), "3": ("response", None), "4": ("response", None), "5": ("response", None), "6": ("response", None)}
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0


def test_warc_of_repeated_and_missing_identifiers(spark, tmp_path):
    big, long, lone = "é" * 600, "y" * 3000, "z" * 2000
    rows = [(4, big), (4, big), (4, long), (1, big), (None, big), (None, lone), (None, lone), (2, long), (9, None)]
    spark.createDataFrame([(i, "u", t, "x") for i, t in rows], "page_id long, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect())
    assert got == collections.Counter({(4, 1200, "response", None): 2, (4, 3000, "response", None): 1, (1, 1200, "revisit", 4): 1, (None, 1200, "revisit", 4): 1, (None, 2000, "response", None): 2, (2, 3000, "revisit", 4): 1, (9, 0, "response", None): 1})


def test_bundles():
    b = warc.Bundle()
    for i in range(300):
        b.add(str(i), warc.record("response", str(i), "u", b"p%d" % i * 99, "d", None))
    raw = b.bytes()
    assert len(b.frames) > 1 and all(warc.read_record(raw, f, o)[1] == b"p%d" % int(i) * 99 for i, f, o, _ in b.index)


def test_mixing_meets_targets(docs, edge):
    got = mixing.mix(docs, carry=("source",)).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert abs(got.groupby("source").target.first().sum() - 1.5 * got["size"].sum()) < 1e-3
    again = mixing.mix(docs, carry=("source",)).toPandas()
    assert sorted(zip(got.doc_id, got.taken, strict=True)) == sorted(zip(again.doc_id, again.taken, strict=True))
    assert mixing.mix(edge.drop("size")).count() == len(EDGE) and mixing.mix(edge.drop("size").limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    base = [f"w{int(x)}" for x in rng.integers(0, 5000, 60)]
    for k in range(40):  # a group of near copies, some near the threshold, longer than a short list
        copy = list(base)
        for _ in range(int(rng.integers(0, 3))):
            copy[int(rng.integers(0, 60))] = f"x{k}{int(rng.integers(0, 99))}"
        rows.append((10_000 + k, " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(50))
    rows += [(20_000 + k, f"{passage} {' '.join(f'q{k}x{i}' for i in range(k % 14))}") for k in range(40)]
    rows += [(30_000 + k, " ".join(f"s{i}" for i in range(k % 9))) for k in range(30)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_near_duplicates_edges(edge):
    got = sorted([tuple(r) for r in near_duplicates.near_duplicates(edge).collect()], key=str)
    by = {i: (n, c) for i, n, c in got}
    assert len(got) == len(EDGE) and by[1] == (0, 1) and by[7] == (6, 7) and by[8] == (6, 7) and by[4] == (1, 4)
    assert near_duplicates.near_duplicates(edge.limit(0)).count() == 0
    kept = [r.doc_id for r in near_duplicates.deduplicated(edge).collect()]
    assert kept.count(4) == 1 and 8 not in kept and {1, 2, 3, 7, None} <= set(kept)


def test_near_duplicates_without_or_with_shared_keys(spark):
    a = " ".join(f"w{i}" for i in range(40))
    near, other, third = a + " x", " ".join(f"v{i}" for i in range(40)), "one two three four five six"
    rows = [(None, a), (1, a), (2, near), (3, other), (3, a), (None, third), (None, third), (None, ""), (None, ""), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA + ", key string, node string, n int, digest int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect())
    assert got == collections.Counter({(None, 36, 1): 1, (1, 36, 1): 1, (2, 37, 1): 1, (3, 36, 3): 1, (3, 36, 1): 1, (None, 2, None): 2, (None, 0, None): 2, (5, 0, 5): 2})
    out = near_duplicates.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, [(1, a), (3, other), (None, third), (None, ""), (None, ""), (5, ""), (5, "")]))


@pytest.mark.parametrize(("turns", "members"), [(6, 1024), (1, 3), (1, 1024)])
def test_near_duplicates_of_a_large_loose_group(spark, monkeypatch, turns, members):
    monkeypatch.setattr(near_duplicates, "TURNS", turns)
    monkeypatch.setattr(near_duplicates, "MEMBERS", members)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(60):  # all share their first half, some pairs are near
        own = base[:60] + [f"t{int(rng.integers(0, 12))}x{i}" for i in range(int(rng.integers(4, 24)))]
        rows.append((k, " ".join(own)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_components(rows)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    assert {r.node: r.comp for r in components.components(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(chain.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "times", "steps"), [(1 << 18, 1, False), (1024, 40, False), (4, 1, True)])
def test_components_by_forests_and_by_steps(spark, monkeypatch, most, times, steps):
    monkeypatch.setattr(components, "TASK_LINKS", most)
    called, large = [], components._large
    monkeypatch.setattr(components, "_large", lambda e: called.append(1) or large(e))
    rng = np.random.default_rng(5)
    links = [(int(x), int(y)) for x, y in rng.integers(-90, 90, (110, 2))] + [(1000 + i, 1001 + i) for i in range(30)]
    want = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in want:
        for x, y in links:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
    with common.scratch(spark):
        got = components.components(spark.createDataFrame(links * times, "x long, y long").repartition(5))
        assert sorted(map(tuple, got.collect())) == sorted(want.items())
        assert [p.name.split("-")[0] for p in Path(common._open[-1].removeprefix("file://")).iterdir()] == ["components"]  # the steps' tables are gone
    assert bool(called) == steps  # those between all tasks are for links that don't shrink to what fits one


def test_near_duplicates_leave_no_turns_on_disk(spark, monkeypatch):
    tables, own = [], near_duplicates.components

    def seen(links):
        tables.append({p.name.split("-")[0] for p in Path(common._open[0].removeprefix("file://")).iterdir()})
        return own(links)

    monkeypatch.setattr(near_duplicates, "components", seen)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base + [f"t{k % 7}x{i}" for i in range(4 + k % 20)])) for k in range(60)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute_components(rows)
    assert len(tables) > 2 and not set().union(*tables) & {"components", "members", "open"} and "links" in tables[-1]


def test_decontamination(spark, edge):
    clean = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    item = " ".join(f"B{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, None), (4, "!!")], "item_id long, text string")
    text = "zz " + ", ".join(f"b{i}" for i in range(3, 17)) + " Yy é one-TWO"
    docs = edge.select("doc_id", "text").union(spark.createDataFrame([(50, text)], SCHEMA))
    got = {r.doc_id: r for r in decontaminate.hits(docs, bench).collect()}
    assert (got[50].n_words, len(got[50].hit_words), got[50].items) == (19, 16, ["1", "2"])
    assert [text[s.start : s.end] for s in got[50].spans] == [", ".join(f"b{i}" for i in range(3, 17)), "one-TWO"]
    assert len(got[4].hit_words) == 2 and not got[1].items and len(clean.findall(text.translate(LOWER))) == 19
    blocks = {r.doc_id: (r.hit_words, r.items) for r in decontaminate.hits(docs.where("doc_id = 50"), bench, block_bytes=20).collect()}
    assert blocks[50] == (got[50].hit_words, got[50].items)
    assert 50 not in [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()]
    assert decontaminate.hits(docs.limit(0), bench).count() == 0 and len(decontaminate.hits(docs, bench.limit(0)).collect()) == docs.count()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_personal_data(docs, edge):
    odd = ["a@b.c@d.e x@y.", "..@a.b", "1.2.3.4.5.6.7.8", "+1+2+34567890123", "1 2-3 4111 1111 1111 1111", "256.1.1.1 01.02.03.0004", "a@@b.c x@b-.-", "é@b.c.d@e.f"]
    for t in [*odd, *(r.text or "" for r in docs.limit(300).collect())]:
        assert pii.base_spans(t) == brute_spans(t)
    weights = pii.trained(docs)
    t = "call +1 (743) 555-3824 or 17435553824 ok"
    base, every = pii.all_spans(t, weights)
    assert set(base) <= set(every)
    assert pii.found(edge, weights).count() == len(EDGE)
    assert "[EMAIL]" in pii.masked(docs.limit(1).select(F.lit(1).alias("doc_id"), F.lit("to a.b@c.de now").alias("text"))).first().text


def test_personal_data_is_consistent_at_any_length():
    skip = 2.0 * np.eye(len(pii.KINDS) + 1)
    for n in (1, 2, 5, 40, 300):
        text = "+1 (743) 555-3824" + " then some more words follow 17435553824" * n
        base = pii.base_spans(text)
        g = pii.Graph(text, base)
        label = g.fixed(base)
        p = pii.infer(g, label, (np.zeros((g.x.shape[1], len(skip))), np.zeros_like(skip), skip))
        assert (label == 0).sum() == n and (p[label == 0].argmax(axis=1) == 4).all() and p[label == 0].max(axis=1).min() > 0.6


def test_quality_separates(spark, sf, docs, edge):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judged(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.2
    assert quality.judged(edge, labels).count() == len(EDGE) and quality.judged(docs.limit(0), labels).count() == 0


def test_quality_thresholds_of_every_language_with_trusted_text(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lonely = spark.createDataFrame([(-1, "xx", "one trusted text"), (-2, "xx", "0#!~^" * 40), (-3, "yy", "no trusted text")], "doc_id long, lang string, text string")
    all_labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(-1, 1)], "doc_id long, quality int"))
    got = quality.judged(docs.select("doc_id", "lang", "text").union(lonely), all_labels).join(all_labels, "doc_id", "left").toPandas().set_index("doc_id")
    assert got[got.lang != "yy"].threshold.notna().all() and got.threshold[-3] != got.threshold[-3] and got.keep[-3]
    for lang in ("de", "es", "fr", "en"):
        own = got[got.lang == lang]
        assert own[own.quality == 1].keep.mean() > 0.9
    junk = got[(got.quality == 0) & (got.lang == "de")]
    assert len(junk) and not junk.keep.all() and got.keep[-1] and not got.keep[-2]
    few = [("a", s, 1) for s in range(10)] + [("b", 100 + s, 1) for s in range(400)] + [(None, 7, 1)]
    limit, over = quality.limits(spark.createDataFrame(few, "lang string, step long, c long"))
    by = {r.lang: r.step for r in limit.collect()}
    away = np.percentile(sorted([s - 4 for s in range(10)] + [s - 199 for s in range(400)] + [0]), 99.5)
    assert by == {"a": 4 + int(away), "b": 497, None: 7 + int(away)} and over == int(np.percentile([r[1] for r in few], 99.5))


def test_toxicity(spark, sf, docs):
    got = QUERIES["op8_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.toxic == 1].score.mean() > 5 * held[held.toxic == 0].score.mean()
    machine = toxicity.fit(["you are such a grumblefoot today", "you are such a nice person today"] * 20, [1, 0] * 20)  # one word explains the label
    df = spark.createDataFrame([(1, "such a g.r.u.m.b.l.e.f.o.o.t"), (2, "nice day"), (3, None), (4, "x" * 9000)], SCHEMA)
    s = {r.doc_id: r.score for r in toxicity.scored(df, machine).collect()}
    assert s[1] > s[2] and len(s) == 4 and all(0 <= v <= 1 for v in s.values())
    assert toxicity.fit(["no toxic label"], [0])[3] < 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (10, 10), (1000, 1 << 20), (5000, 6000), (3000, 1 << 63)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        q = np.concatenate([v, rng.integers(0, top, n, dtype=np.uint64), np.array([0, top, (1 << 64) - 1], np.uint64)])
        at = np.searchsorted(v, q)
        ok = at < len(v)
        ok[ok] = v[at[ok]] == q[ok]
        assert (eliasfano.EliasFano.build(v).find(q) == np.where(ok, at, -1)).all()


def test_language_model_paths_agree(docs, edge):
    for df in (docs.limit(150), edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
        one = language_model.scores(df, language_model.train(df.where(train).select("text"))).toPandas().set_index("doc_id").sort_index()
        two = language_model.joined_scores(df, train).toPandas().set_index("doc_id").sort_index()
        assert np.allclose(one.score, two.score) and np.allclose(one.base_score, two.base_score) and (one.n_known == two.n_known).all()
        rows = {r.doc_id: words(r.text) for r in df.collect()}
        c = collections.Counter()
        for i, w in rows.items():
            if zlib.crc32(str(i).encode()) % 7 != 2:
                c.update([*w, None])
        n, v = sum(c.values()), len(c)
        for i, w in rows.items():
            assert math.isclose(one.base_score[i], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), rel_tol=1e-9)


def test_language_model_keeps_all_pairs_and_triples(spark, edge, docs):
    rows = [(1, "a b c d"), (2, "e f"), (3, "a b c d")]
    df = spark.createDataFrame(rows, SCHEMA)
    train = F.col("doc_id") < 3
    words_of = lambda d: language_model.save(language_model.word_level(d.where(train).select("text"))[0])
    got = {r.doc_id: r.score for r in language_model.sharded_scores(df, train, words_of(df)).collect()}
    # 8 tokens of 7 kinds; each word once, so pairs and triples once, too: p = 1 / 4 and rest = 3 / 4 at both orders, but two texts' starts
    value = lambda p: 2.0 ** (-math.ceil(-8 * math.log2(p) - 1e-9) / 8)
    rest = lambda p: value(1 - p)
    one, start = value(0.25), value(0.125)
    order2 = lambda p, r, c: p + r * (c + 1) / 16
    first = order2(start, rest(2 * start), 1)
    inner, end = (one + rest(one) * order2(one, rest(one), c) for c in (1, 2))
    assert math.isclose(got[1], math.log10(first) + 3 * math.log10(inner) + math.log10(end), rel_tol=1e-9) and math.isclose(got[3], got[1])
    for d in (docs.limit(150), edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
        one = language_model.scores(d, language_model.train(d.where(train).select("text"))).toPandas().set_index("doc_id").sort_index()
        two = language_model.sharded_scores(d, train, words_of(d)).toPandas().set_index("doc_id").sort_index()
        assert np.allclose(one, two) and list(one.columns) == list(two.columns)
    train = F.lit(True)
    assert language_model.sharded_scores(edge, train, words_of(edge)).count() == len(EDGE)
    train = F.lit(False)
    assert {r.score for r in language_model.sharded_scores(edge, train, words_of(edge)).collect()} == {0.0} and language_model.sharded_scores(edge.limit(0), train, words_of(edge)).count() == 0
