"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

A text is normalised (A-Z lowered, words of letters, digits and non-ASCII
characters), its words become numbers, and these are scanned once. The automaton's
patterns are segments that tile the items, of half a window's words: each window of
an item holds a whole one. Where a segment occurs, the text is compared with the item
to both sides; a run of equal words as long as a window, or longer, is made of
windows. So the automaton has a node for a word of the items, not one for each word
of each window. Hit words are mapped to offsets of the original text.

Edge cases: a null or empty text, or one without words, has no hits; an item
without words has no window; an item of fewer words than a window is one window
as a whole; equal windows of several items count for each of them. Each row is
looked at for itself, also if rows repeat, share a key or have none; an empty table
gives an empty result, and without items nothing is hit. Extra columns pass through
decontaminate() untouched, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, tidy, without

WINDOW = 13
#: Bytes of item text that one automaton is built over (some 15 bytes of a worker's memory for each); more items make more automata.
BLOCK_BYTES = 16 << 20

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in the original, upper case too


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class Items:
    """The items' words as numbers, and one automaton over the segments that tile them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.names, self.words = window, [], []
        self.number: dict[bytes, int] = {}
        for name, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in normalised(text))
            if words:
                self.names.append(name)
                self.words.append(words)
        part = (window + 1) // 2
        at: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, words in enumerate(self.words):
            if len(words) < window:
                at.setdefault(words, []).append((i, 0))
            else:
                for p in range(0, len(words) - part + 1, part):
                    at.setdefault(words[p : p + part], []).append((i, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for segment, where in at.items():
            self.automaton.add_word(segment, (len(segment), tuple(where)))
        if at:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, hit words (indices), items."""
        found = normalised(text)
        n, items = len(found), set()
        if not found or not self.words:
            return n, np.zeros(0, np.int64), items
        get = self.number.get
        ids = tuple([get(w, 0) for w in found])  # 0: a word that no item has
        delta, seen = np.zeros(n + 1, np.int64), {}
        for last, (size, where) in self.automaton.iter(ids):
            first = last - size + 1
            for i, p in where:
                words = self.words[i]
                if seen.get((i, first - p), -1) >= last:  # in a run that was compared
                    continue
                lo, hi, q = first, last + 1, p + size
                while p and lo and ids[lo - 1] == words[p - 1]:
                    lo, p = lo - 1, p - 1
                while q < len(words) and hi < n and ids[hi] == words[q]:
                    hi, q = hi + 1, q + 1
                seen[i, lo - p] = hi - 1
                if hi - lo >= min(self.window, len(words)):
                    items.add(self.names[i])
                    delta[lo] += 1
                    delta[hi] -= 1
        return n, np.flatnonzero(np.cumsum(delta)[:-1] > 0), items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as [start, end) in characters of the original text."""
    if not len(hit):
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    cut = np.flatnonzero(np.diff(hit) > 1) + 1
    return [(spans[r[0]][0], spans[r[-1]][1]) for r in np.split(hit, cut)]


_built: dict[str, Items] = {}

SCHEMA = "n_words long, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def hits(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: key, n_words, hit words, items and original spans.

    Items are dealt to blocks of block_bytes, each with its own broadcast automaton;
    the usual test sets make one. With more, the texts are written with a number for
    each row first, by which the blocks' results are merged.
    """
    spark = docs.sparkSession
    bench = bench.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    docs = docs.withColumn("row", F.lit(0).cast("long")) if blocks == 1 else staged(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    out_schema = f"key {docs.schema['key'].dataType.simpleString()}, row long, {SCHEMA}"
    parts = []
    for b in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        sent, name = spark.sparkContext.broadcast(sorted((str(r.item), r.t) for r in own.collect())), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                _built[name] = Items(sent.value, window)
            a = _built[name]
            for batch in batches:
                n_words, hit, items, spans = [], [], [], []
                for t in batch.column(1):
                    t = t.as_py()
                    n, h, who = a.scan(t)
                    n_words.append(n)
                    hit.append(h)
                    items.append(sorted(who))
                    spans.append([{"start": s, "end": e} for s, e in original_spans(t, h)] if len(h) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["key", "row", "n_words", "hit_words", "items", "spans"])

        parts.append(docs.mapInArrow(tidy(run), out_schema))
    if len(parts) == 1:
        return parts[0].select(F.col("key").alias(key), "n_words", "hit_words", "items", "spans")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  as many rows a document as blocks
    every = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.first("n_words").alias("n_words"), union("hit_words"), union("items"))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": s, "end": e} for s, e in original_spans(t.as_py() or "", np.array(h.as_py(), np.int64))] for t, h in zip(batch.column("text"), batch.column("hit_words"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "n_words", "hit_words", "items"]).columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=[key, "n_words", "hit_words", "items", "spans"])

    return docs.join(every, "row").mapInArrow(tidy(locate), f"{key} {docs.schema['key'].dataType.simpleString()}, {SCHEMA}")


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated ones; rows that share a key, or have none, go each by their own text."""
    base = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("digest")).alias("key"), F.col(text).alias("text"))
    bad = hits(base, bench, "key").where(contaminated(F.size("hit_words"), F.col("n_words"))).select("key.key", "key.digest").distinct()
    return without(docs, staged(bad, "contaminated"), docs[key], F.xxhash64(docs[text]))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_hit = F.size("hit_words").cast("long")
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dg AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN wins USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
