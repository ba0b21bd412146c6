"""Language-model scoring by a trigram trie of Elias-Fano levels.

Training counts every word, every pair of words and every triple of the training
texts; all are kept. The trie: words by hash (level 1), their successors with
monotone pointers (level 2), and for each pair the third words, named by their
place among the successors of the second word (level 3). A query finds the
successor of its key inside the range of its context. Probabilities are absolute
discounts interpolated down to (c + 1) / (N + V + 1), and are kept as 8-bit
logarithms; what rounding leaves is given to the lower order, so that no context
sums to more than 1.

The query's trie is in shards, and no machine holds the whole model
(sharded_scores). Level 1 is broadcast while it fits VOCABULARY; beyond, it stays
in shards by hash, which slices of texts ask for the places and counts of their
words. Levels 2 and 3 are made by ranges of the last word of the context in the
executors (branch): a range has all that the tokens behind its words need. There
the contexts of level 3 are the words before each word, as their own pairs are in
another range. Workers map all levels into memory. train() and scores() hold all
levels at once, for models of up to GRAMS pairs and triples. joined_scores() is
for comparison only: joins of tables of tokens and counts, without a trie. All give
the same probabilities but for rounding.

Edge cases: null and empty texts have the end token alone; without training
texts N and V are 0 and every token has base 1; repeated rows count and score each,
as do rows that share a key or have none (the query doesn't hold out a null key);
texts of any length are scored whole; an empty table gives an empty result. Other
columns are not read. Keys must be integers or strings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, counted, flat, free, pack, shard_bounds, shards, slices, staged, table, tidy, tidy_group, tidy_pair, unpack, word_hashes, word_spans
from .eliasfano import EliasFano, load, save

DISCOUNT = 0.75
#: Most words of a level 1 that is broadcast, and most pairs or triples of a trie that is held at once (about 7 and 5 bytes each).
VOCABULARY, GRAMS = 1 << 18, 1 << 24
_GATHER = 1 << 20
#: Tokens of a range that are looked up at once.
_GROUP = 1 << 19
#: Bytes of text looked up at once: frequent words are then looked up once.
SLICE = 1 << 22
_END, _START = np.uint64(0x5E9D_0000_0000_0001), np.uint64(0x5E9D_0000_0000_0002)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def quantised(p: np.ndarray) -> np.ndarray:
    """Eighths of an octave below 1, rounded down to the next smaller probability; 255 is the least."""
    return np.minimum(np.ceil(-8 * np.log2(np.maximum(p, 1e-12)) - 1e-9), 255).astype(np.uint8)


_VALUE = 2.0 ** (-np.arange(256) / 8)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of each text, and each text's first token (n + 1)."""
    data = LOWER[data[off[0] : off[-1]]]
    starts, ends, first = word_spans(data, off - off[0])
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    at = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.empty(at[-1], np.uint64)
    out[at[:-1]], out[at[1:] - 1] = _START, _END
    out[np.arange(len(h)) + np.repeat(at[:-1] + 1 - first[:-1], n)] = h
    return out, at


def _deal(n: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Counts of spread keys, a row for each shard that has any."""
    b = shard_bounds(keys, n)
    own = np.flatnonzero(np.diff(b))
    cut = [slice(b[s], b[s + 1]) for s in own.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([pack(keys[c]) for c in cut], pa.binary()), pa.array([_planes(counts[c]) for c in cut], pa.binary())], names=["shard", "keys", "counts"])


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _counts_of(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


def _tight(raw: bytes) -> bytes:
    """Packed numbers with their bytes' entropy taken out, which Spark's own codec leaves in."""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _loose(raw: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw.as_buffer())


def gathered(docs: DataFrame, make: object, n: int | None = None) -> DataFrame:
    """Sums over all docs (text) of the keys that make(data, off) gives, packed by shard (of n).

    Tasks count what they hold before it is dealt out, and keys are spread evenly,
    so frequent words or pairs make no large shard.
    """
    n = n or shards(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, off = flat(batch.column(0))
            for i, j in slices(off, SLICE):
                held.append(make(data, off[i : j + 1]) * _SPREAD)
                size += len(held[-1])
                if size >= _GATHER:
                    yield _deal(n, *counted(np.concatenate(held)))
                    held, size = [], 0
        if size:
            yield _deal(n, *counted(np.concatenate(held)))

    def add(group: pa.Table) -> pa.Table:
        keys, c = counted(np.concatenate([unpack(x.as_py()) for x in group.column("keys")]), np.concatenate([_counts_of(x.as_py()) for x in group.column("counts")]))
        keys = keys * _BACK
        order = np.argsort(keys)
        return pa.table({"shard": group.column("shard")[:1], "keys": pa.array([pack(keys[order])], pa.binary()), "counts": pa.array([c[order].astype("<u4").tobytes()], pa.binary()), "n": [len(keys)], "total": [int(c.sum())]})

    dealt = docs.mapInArrow(tidy(run), "shard int, keys binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(tidy_group(add), "shard int, keys binary, counts binary, n long, total long")


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("keys", "counts").toArrow()
    keys = np.concatenate([unpack(x.as_py()) for x in got.column("keys")] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in got.column("counts")] or [np.zeros(0, "<u4")])
    del got
    order = np.argsort(keys).astype(np.uint32)
    keys, counts = keys[order], counts[order]
    del order
    free()
    return keys, counts


class Trie:
    """The levels over arrays in memory or in a mapped file."""

    def __init__(self, a: dict[str, np.ndarray]):
        level = lambda k: EliasFano.of({p.split(".", 1)[1]: v for p, v in a.items() if p.startswith(k + ".")})
        self.a, self.words = a, level("words")
        self.total, self.kinds, self.wide, self.rel = a["sizes"].tolist()
        self.pairs = level("pairs") if "pairs.meta" in a else None
        self.heads = level("pointers") if "pointers.meta" in a else None
        self.triples = level("triples") if "triples.meta" in a else None

    def count(self, i: np.ndarray) -> np.ndarray:
        """Training count of words by their place (-1: none); over 254 they stand in a list."""
        if not len(self.a["small"]):
            return np.zeros(len(i), np.int64)
        c = np.where(i >= 0, self.a["small"][i], 0).astype(np.int64)
        if (big := np.flatnonzero(c == 255)).size:
            c[big] = self.a["large"][np.searchsorted(self.a["large_at"], i[big])]
        return c

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count of each token's word; the ranges of its successors are kept for pair()."""
        uniq, inverse = np.unique(h, return_inverse=True)
        at = self.words.find(uniq)
        if self.heads is not None:
            begin, end = self.pointers(np.maximum(at, 0))
            self.begin, self.end = begin[inverse], end[inverse]
        return at[inverse], self.count(at)[inverse]

    def pair(self, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """For each token the place of the pair that it ends, or -1. keep: words that pairs are made of."""
        out = np.full(len(at), -1, np.int64)
        ok = np.flatnonzero(keep[1:] & keep[:-1]) + 1
        v = at[ok - 1]
        begin, end = self.begin[ok - 1], self.end[ok - 1]
        has = begin < end
        ok, v, begin, end = ok[has], v[has], begin[has], end[has]
        # distinct keys in order: each is searched once, and neighbours lie near each other in memory
        uniq, index, inverse = np.unique(v.astype(np.uint64) * np.uint64(self.wide) + at[ok].astype(np.uint64), return_index=True, return_inverse=True)
        out[ok] = self.pairs.find(uniq, begin[index], end[index])[inverse]
        return out

    def pointers(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the successors of words, by the monotone pointers of level 1."""
        begin, end = self.heads.bucket(np.minimum(v, self.heads.most))
        return begin, np.where(v > self.heads.most, begin, end)

    def triple_keys(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that end a triple of two kept pairs, and its key: first pair, then the last word's place among successors."""
        ok = np.flatnonzero((pair[1:] >= 0) & (pair[:-1] >= 0)) + 1
        return ok, pair[ok - 1].astype(np.uint64) * np.uint64(self.rel) + (pair[ok] - self.begin[ok - 1]).astype(np.uint64)

    def score(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base and model log10 probabilities and training count of each token; a text's start has none (0)."""
        at, c = self.ids(h)
        begin = np.zeros(len(h), bool)
        begin[first] = True
        low = (c + 1) / (self.total + self.kinds + 1)
        p = low.copy()
        if self.pairs is not None and self.pairs.n:
            keep = (c > 0) | begin
            keep[begin] = at[begin] >= 0
            pair = self.pair(at, keep)
            pair[first] = -1
            prev = np.concatenate([[-1], at[:-1]])
            known = prev >= 0
            gamma = np.ones(len(h))
            gamma[known] = _VALUE[self.a["rest2"][prev[known]]]
            p = gamma * low
            hit = pair >= 0
            p[hit] += _VALUE[self.a["prob2"][pair[hit]]]
            if self.triples is not None and self.triples.n:
                context = np.concatenate([[-1], pair[:-1]])
                inside = context >= 0
                p[inside] *= _VALUE[self.a["rest3"][context[inside]]]
                ok, key = self.triple_keys(pair)
                uniq, inverse = np.unique(key, return_inverse=True)
                t = self.triples.find(uniq)[inverse]
                p[ok[t >= 0]] += _VALUE[self.a["prob3"][t[t >= 0]]]
        base, model = np.log10(low), np.log10(p)
        base[begin] = model[begin] = 0
        c[begin] = 0
        return base, model, c


def _level(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in ef.parts().items()}


def _rest(parent: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """What quantised shares leave of each parent, quantised down."""
    left = 1 - np.bincount(parent, weights=value, minlength=n)
    return quantised(np.maximum(left, 1e-9))


_mapped: dict[str, Trie] = {}


def _map(raw: bytes) -> dict[str, np.ndarray]:
    """The arrays of save(), written to a file of the worker's own and mapped."""
    with tempfile.NamedTemporaryFile() as f:  # the mapping outlives the file's name
        f.write(raw)
        f.flush()
        return load(np.memmap(f.name, np.uint8, "r"))


def mapped(name: str, raw: bytes) -> Trie:
    """The trie of a broadcast block; one at a time."""
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = Trie(_map(raw))
    return _mapped[name]


def _words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return tokens(data, off)[0]


def word_shards(docs: DataFrame, train_on: F.Column, text: str = "text") -> DataFrame:
    """shard, keys, counts, n, total: the words of the texts of docs that train_on holds for, in shards by hash."""
    return staged(gathered(docs.where(train_on).select(text), _words, shards(docs.sparkSession, docs)), "words")


def _small(level: DataFrame) -> bool:
    return level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= VOCABULARY


def _whole(level: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Level 1 of word_shards() in one piece, and its counts."""
    keys, counts = _collected(level)
    real = keys != _START  # starts are contexts, not tokens
    a = {"sizes": np.array([int(counts[real].sum(dtype=np.int64)), int(real.sum()), len(keys), 0], np.int64), "small": np.minimum(counts, 255).astype(np.uint8)}
    large = np.flatnonzero(a["small"] == 255)
    a |= {"large_at": large.astype(np.int64), "large": counts[large].astype(np.int64), **_level("words", EliasFano.build(keys))}
    del keys, real
    free()
    return a, counts


def word_level(docs: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """Level 1 of all texts of docs (text), and its counts; None if it would be too large to broadcast."""
    level = staged(gathered(docs, _words), "words")
    return _whole(level) if _small(level) else None


def train(docs: DataFrame) -> bytes | None:
    """The trie of all texts of docs (text); None if it would be too large to broadcast."""
    sc = docs.sparkSession.sparkContext
    words = word_level(docs)
    if words is None:
        return None
    a, counts = words
    if not len(counts):
        return save(a)

    def spread(make: object) -> tuple[np.ndarray, np.ndarray] | None:
        sent, name = sc.broadcast(save(a)), uuid.uuid4().hex

        def run(data: np.ndarray, off: np.ndarray) -> np.ndarray:
            return make(mapped(name, sent.value), *tokens(data, off))

        got = staged(gathered(docs, run), "grams")
        sent.destroy()
        free()
        if (got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) > GRAMS:
            return None
        return _collected(got)

    def pairs(t: Trie, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, c = t.ids(h)
        ok = c > 0
        ok[1:] &= ok[:-1]
        ok[first[:-1]] = False
        end = np.flatnonzero(ok)
        return at[end - 1].astype(np.uint64) * np.uint64(t.wide) + at[end].astype(np.uint64)

    def triples(t: Trie, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        at, c = t.ids(h)
        pair = t.pair(at, c > 0)
        pair[first[:-1]] = -1
        return t.triple_keys(pair)[1]

    got = spread(pairs)
    if got is None:
        return None
    keys, pair_counts = got
    wide = len(counts)
    parent = (keys // np.uint64(wide)).astype(np.int64)
    a["prob2"] = quantised((pair_counts - DISCOUNT) / np.maximum(counts[parent], 1))
    a["rest2"] = _rest(parent, _VALUE[a["prob2"]], wide)
    a["sizes"][3] = int(np.bincount(parent, minlength=1).max(initial=0)) + 1
    a |= _level("pointers", EliasFano.build(parent.astype(np.uint64), 0)) | _level("pairs", EliasFano.build(keys))
    del keys, parent, got
    got = spread(triples)
    if got is None:
        return None
    keys, c = got
    parent = (keys // np.uint64(a["sizes"][3])).astype(np.int64)
    a["prob3"] = quantised((c - DISCOUNT) / np.maximum(pair_counts[parent], 1))
    a["rest3"] = _rest(parent, _VALUE[a["prob3"]], len(pair_counts))
    a |= _level("triples", EliasFano.build(keys))
    del keys, c, parent, got
    raw = save(a)
    a.clear()
    free()
    return raw


OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, raw: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    sent, name = docs.sparkSession.sparkContext.broadcast(raw), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = mapped(name, sent.value)
        for batch in batches:
            data, off = flat(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, j in slices(off, SLICE):
                h, at = tokens(data, off[i : j + 1])
                base, model, c = trie.score(h, at[:-1])
                for o, v in zip(out, (np.diff(at) - 1, np.add.reduceat((c > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(model, at[:-1])), strict=True):
                    o.append(v)
            n, known, base, model = (np.concatenate(o) if o else np.zeros(0) for o in out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), trie.total), pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {OUT}")


def branch(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray, n: int, words: int) -> dict[str, np.ndarray]:
    """Levels 2 and 3 behind n words, from the counts c of the distinct training tokens w behind u, v, ordered by v, u, w.

    u is a word if it is under words. pairs: (v, w) by pointers of v; contexts: (v, u) by pointers of v;
    triples: (context, place of w among the successors of v) by pointers of the context.
    """
    wide = np.uint64(words + 2)
    pairs, c2 = counted(v * wide + w, c)
    parent = (pairs // wide).astype(np.int64)
    a = {"prob2": quantised((c2 - DISCOUNT) / np.bincount(parent, weights=c2, minlength=n)[parent])}
    a["rest2"] = _rest(parent, _VALUE[a["prob2"]], n)
    full = u < words  # the first word of a text has no triple
    v, u, w, c = v[full], u[full], w[full], c[full]
    contexts, total = counted(v * wide + u, c)
    own = np.searchsorted(contexts, v * wide + u)
    place = np.searchsorted(pairs, v * wide + w) - np.searchsorted(parent, v.astype(np.int64))
    most = int(place.max(initial=0)) + 1
    a["prob3"] = quantised((c - DISCOUNT) / total[own])
    a["rest3"] = _rest(own, _VALUE[a["prob3"]], len(contexts))
    a["sizes"] = np.array([words + 2, most], np.int64)
    for name, keys, of in (("pairs", pairs, parent), ("contexts", contexts, contexts // wide), ("triples", own.astype(np.uint64) * np.uint64(most) + place.astype(np.uint64), own)):
        a |= _level(name, EliasFano.build(keys)) | _level(f"{name}_of", EliasFano.build(of.astype(np.uint64), 0))
    return a


class Branch:
    """The levels of branch() over arrays in memory or in a mapped file."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.a = a
        self.wide, self.most = (np.uint64(x) for x in a["sizes"].tolist())
        self.level = {k: EliasFano.of({x: a[f"{k}.{x}"] for x in ("meta", "lows", "highs", "zeros")}) for name in ("pairs", "contexts", "triples") for k in (name, f"{name}_of")}

    def range_of(self, name: str, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of each place of the level above begin and end."""
        heads = self.level[f"{name}_of"]
        begin, end = heads.bucket(np.minimum(of, heads.most))
        return begin, np.where(of > heads.most, begin, end)

    def probability(self, v: np.ndarray, u: np.ndarray, own: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The probability of each w behind context `own` of the distinct ones u, v, which are in v's order; low: that of w by itself."""
        heads, to = np.unique(v, return_inverse=True)
        begin, end = self.range_of("contexts", heads.astype(np.int64))
        context = self.level["contexts"].find(v * self.wide + u, begin[to], end[to])
        begin, end = self.range_of("pairs", heads.astype(np.int64))
        uniq, at = np.unique(v[own] * self.wide + w, return_inverse=True)  # each pair is searched once
        of = np.searchsorted(heads, uniq // self.wide)
        pair = self.level["pairs"].find(uniq, begin[of], end[of])
        place, pair = (pair - begin[of])[at], pair[at]
        p = _VALUE[self.a["rest2"][v.astype(np.int64)]][own] * low
        p[pair >= 0] += _VALUE[self.a["prob2"][pair[pair >= 0]]]
        rest = np.ones(len(v))
        rest[context >= 0] = _VALUE[self.a["rest3"][context[context >= 0]]]
        p *= rest[own]
        begin, end = self.range_of("triples", np.maximum(context, 0))
        both = np.flatnonzero((context[own] >= 0) & (pair >= 0))
        of = own[both]
        t = self.level["triples"].find(context[of].astype(np.uint64) * self.most + place[both].astype(np.uint64), begin[of], end[of])
        p[both[t >= 0]] += _VALUE[self.a["prob3"][t[t >= 0]]]
        return p


def _asked(words: int, even: int, vu: np.ndarray, w: np.ndarray, c: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Model log10 probability of each token of a range of contexts.

    vu, w: last and last but one word of the context, and the word, of `words`; c: the word's count; even: what
    counts are divided by; trained: tokens that are counted. The range holds every token behind its last words.
    """
    width = np.uint64(words + 2)
    ctx, rank = np.unique(vu, return_inverse=True)
    gram, at = np.unique(rank.astype(np.uint64) * width + w, return_inverse=True)
    own, w = (gram // width).astype(np.int64), gram % width
    del rank
    c3 = np.bincount(at[trained], minlength=len(gram))
    low = np.empty(len(gram))
    low[at] = (c + 1) / even
    v, u = ctx // width, ctx % width
    v -= v[0]
    on = np.flatnonzero(c3)
    levels = Branch(_map(save(branch(v[own[on]], u[own[on]], w[on], c3[on], int(v[-1]) + 1, words))))
    return np.log10(levels.probability(v, u, own, w, low))[at]


def sharded_scores(docs: DataFrame, train_on: F.Column, words: bytes | DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As train() and scores(), with the levels of pairs and triples made by ranges of the context's last word.

    words: level 1 in one piece, or word_shards() of it. Each slice of texts deals its tokens to the ranges, which
    send sums for its rows back. Where level 1 is in shards, a slice first asks them for its distinct words.
    """
    spark = docs.sparkSession
    n = shards(spark, docs)
    if isinstance(words, bytes):
        total, kinds, wide, _ = load(np.frombuffer(words, np.uint8))["sizes"].tolist()
        sent, name = spark.sparkContext.broadcast(words), uuid.uuid4().hex
    else:
        parts = words.select("shard", "n", "total").orderBy("shard").collect()
        begins = docs.where(train_on).count()  # starts are contexts, not tokens
        wide, total = sum(r.n for r in parts), sum(r.total for r in parts) - begins
        kinds = wide - (begins > 0)
        before = dict(zip((r.shard for r in parts), np.cumsum([0, *(r.n for r in parts)]).tolist(), strict=False))
    even = total + kinds + 1
    width = np.uint64(wide + 2)  # after the words: one that isn't known, and none
    kind = docs.schema[key].dataType.simpleString()
    sums = f"ids array<{kind}>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, model array<double>"

    def dealt_rows(ids: pa.Array, trained: np.ndarray, ident: int, first: np.ndarray, at: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        """A slice's head and its tokens for each range; at, c: place (-1: none) and count of each token."""
        edges = np.array([-(-i * wide // n) for i in range(n + 1)], np.uint64) * width
        begin = np.zeros(len(at), bool)
        begin[first[:-1]] = True
        low = np.log10((c + 1) / even)
        low[begin], c[begin] = 0, 0
        v = np.concatenate([[-1], at[:-1]])
        u = np.concatenate([[-1, -1], np.where(at >= 0, at, wide)[:-2]])
        u[first[:-1] + 1] = wide + 1
        ask = np.flatnonzero(~begin & (v >= 0))  # behind an unknown word the base is all
        vu = v[ask].astype(np.uint64) * width + u[ask].astype(np.uint64)
        order = np.argsort(vu)
        vu, ask = vu[order], ask[order]
        w = np.where(at[ask] >= 0, at[ask], wide).astype(np.uint64)
        row = (np.repeat(np.arange(len(trained)), np.diff(first)) * 2 + np.repeat(trained, np.diff(first)))[ask]
        b = np.searchsorted(vu, edges)
        parts = [(int(s), slice(b[s], b[s + 1])) for s in np.flatnonzero(np.diff(b))]
        rest = low.copy()
        rest[ask] = 0
        lists = [ids.to_pylist(), *(np.add.reduceat(x, first[:-1]).tolist() for x in ((~begin).astype(np.int64), (c > 0).astype(np.int64), low, rest))]
        none = [None] * len(parts)
        sent: list[list[bytes]] = [[], [], []]  # a part's distinct words and their counts, and which of them each token is
        for _, p in parts:
            every, index, which = np.unique(w[p], return_index=True, return_inverse=True)
            for out, x in zip(sent, (pack(every), _planes(c[ask[p][index]]), _planes(which)), strict=True):
                out.append(_tight(x))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1 - ident % n, *(s for s, _ in parts)], pa.int32()),
                pa.array([ident] * (len(parts) + 1), pa.int64()),
                *(pa.array([None, *x], pa.binary()) for x in ([_tight(pack(vu[p])) for _, p in parts], *sent, [_tight(_planes(row[p])) for _, p in parts])),
                *(pa.array([x, *none], pa.list_(t)) for x, t in zip(lists, (ids.type, pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)),
            ],
            names=["shard", "block", "vu", "words", "counts", "w", "row", "ids", "n_tokens", "n_known", "base", "model"],
        )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
        """Slices of rows, and the slice's number: the same ones each time a table is read."""
        for batch in batches:
            _, off = flat(batch.column(1))
            for i, j in slices(off, SLICE):
                yield batch.slice(i, j - i), batch.column(3)[i].as_py()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int, np.ndarray, np.ndarray]]:
        """rows_of(), which of the rows are counted, and their tokens."""
        for rows, ident in rows_of(batches):
            yield rows, rows.column(2).fill_null(False).to_numpy(zero_copy_only=False), ident, *tokens(*flat(rows.column(1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = mapped(name, sent.value)
        for rows, trained, ident, h, first in cut(batches):
            yield dealt_rows(rows.column(0), trained, ident, first, *trie.ids(h))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's distinct words for each shard of level 1."""
        for _, _, ident, h, _ in cut(batches):
            keys = counted(h * _SPREAD)[0]
            b = shard_bounds(keys, n)
            own = np.flatnonzero(np.diff(b)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([ident] * len(own), pa.int64()), pa.array([pack(keys[b[s] : b[s + 1]]) for s in own], pa.binary())], names=["shard", "block", "asked"])

    def tell(group: pa.Table, own: pa.Table) -> pa.Table:
        """Places (from 1; 0: none) and counts of the words that were asked for, in their order."""
        shard = group.column("shard")[0].as_py() if len(group) else -1
        asked = [unpack(x.as_py()) * _BACK for x in group.column("asked")]
        places, counts = [np.zeros(len(a), np.int64) for a in asked], [np.zeros(len(a), np.int64) for a in asked]
        if len(own) and len(group):
            level, every = EliasFano.build(unpack(own.column("keys")[0].as_py())), np.frombuffer(own.column("counts")[0].as_py(), "<u4")
            for a, place, c in zip(asked, places, counts, strict=True):
                at = level.find(a)
                place[at >= 0], c[at >= 0] = at[at >= 0] + before[shard] + 1, every[at[at >= 0]]
        return pa.Table.from_arrays([group.column("shard"), group.column("block"), *(pa.array([_tight(_planes(x)) for x in v], pa.binary()) for v in (places, counts))], names=["shard", "block", "places", "counts"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's rows, as a shard before the first."""
        for rows, ident in rows_of(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as f:
                f.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([ident], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["shard", "block", "places", "counts"])

    def meet(group: pa.Table) -> pa.Table:
        """dealt_rows() of a slice from what it was told."""
        group = group.sort_by("shard")
        if group.column("shard")[0].as_py() >= 0:
            raise ValueError("a table gave other rows when it was read again")
        rows = pa.ipc.open_stream(group.column("places")[0].as_buffer()).read_all().combine_chunks().to_batches()
        ((rows, trained, ident, h, first),) = cut(rows)
        at, c = (np.concatenate([_counts_of(_loose(x)) for x in group.column(k)[1:]]) for k in ("places", "counts"))
        uniq, inverse = np.unique(h * _SPREAD, return_inverse=True)
        if len(uniq) != len(at):
            raise ValueError("a table gave other rows when it was read again")
        return pa.Table.from_batches([dealt_rows(rows.column(0), trained, ident, first, at[inverse] - 1, c[inverse])])

    def score(group: pa.Table) -> pa.Table:
        heads = ["ids", "n_tokens", "n_known", "base", "model"]
        if group.column("shard")[0].as_py() < 0:
            return group.select(["shard", "block", "row", "w", *heads])
        vu = [unpack(_loose(x)) for x in group.column("vu")]
        end = np.cumsum([len(x) for x in vu])
        vu = np.concatenate(vu)
        which, row = ([_counts_of(_loose(x)).astype(np.uint32) for x in group.column(k)] for k in ("w", "row"))
        w = np.concatenate([unpack(_loose(x)).astype(np.uint32)[i] for x, i in zip(group.column("words"), which, strict=True)])
        c = np.concatenate([_counts_of(_loose(x)).astype(np.uint32)[i] for x, i in zip(group.column("counts"), which, strict=True)])
        row = np.concatenate(row)
        del which
        # by smaller ranges of v, which keeps what is held beside the tokens small
        v = (vu // width).astype(np.uint32)
        p = np.empty(len(vu))
        cuts = np.linspace(int(v.min()), int(v.max()) + 1, -(-len(vu) // _GROUP) + 1).astype(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            on = np.flatnonzero((v >= a) & (v < b))
            if len(on):
                p[on] = _asked(wide, even, vu[on], w[on].astype(np.uint64), c[on].astype(np.int64), (row[on] & 1).astype(bool))
        del vu, v, w, c
        rows, sums = [], []
        for a, b in zip([0, *end[:-1]], end, strict=True):
            own, to = np.unique(row[a:b] >> 1, return_inverse=True)
            rows.append(_planes(own)), sums.append(np.bincount(to, weights=p[a:b]).tobytes())
        del p, row
        empty = [pa.nulls(len(group), group.schema.field(c).type) for c in heads]
        return pa.Table.from_arrays([group.column("shard"), group.column("block"), pa.array(rows, pa.binary()), pa.array(sums, pa.binary()), *empty], names=["shard", "block", "row", "w", *heads])

    def add(group: pa.Table) -> pa.Table:
        shard = group.column("shard").to_numpy()
        order = np.argsort(shard)  # the head, then ranges in order: sums don't depend on the order of arrival
        head = group.slice(order[0], 1)
        lists = [head.column(c).combine_chunks().flatten() for c in ("ids", "n_tokens", "n_known", "base", "model")]
        model = lists[4].to_numpy().copy()
        for i in order[1:].tolist():
            model[_counts_of(group.column("row")[i].as_py())] += np.frombuffer(group.column("w")[i].as_py(), np.float64)
        return pa.Table.from_arrays([*lists[:3], pa.array(np.full(len(model), total), pa.int64()), lists[3], pa.array(model)], names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    read = docs.select(key, text, train_on.alias("train"), F.monotonically_increasing_id().alias("ident"))
    schema = f"shard int, block long, vu binary, words binary, counts binary, w binary, row binary, {sums}"
    if isinstance(words, bytes):
        dealt = read.mapInArrow(tidy(deal), schema)
    else:
        asked = read.mapInArrow(tidy(ask), "shard int, block long, asked binary")
        told = "shard int, block long, places binary, counts binary"
        answers = asked.groupBy("shard").cogroup(words.select(F.col("shard").alias("of"), "keys", "counts").groupBy("of")).applyInArrow(tidy_pair(tell), told)
        dealt = answers.union(read.mapInArrow(tidy(send), told)).groupBy("block").applyInArrow(tidy_group(meet), schema)
    parts = dealt.groupBy("shard").applyInArrow(tidy_group(score), f"shard int, block long, row binary, w binary, {sums}")
    return parts.groupBy("block").applyInArrow(tidy_group(add), f"{key} {kind}, {OUT}")


def joined_scores(docs: DataFrame, train_on: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As train() and scores(), by joins of token and count tables, without a trie: for comparison, the query doesn't use it."""
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    seq = F.concat(F.array(F.struct(F.lit("s").alias("k"), F.lit("").alias("w"))), F.transform(words, lambda w: F.struct(F.lit("w").alias("k"), w.alias("w"))), F.array(F.struct(F.lit("e").alias("k"), F.lit("").alias("w"))))
    rows = staged(docs.select(F.col(key).alias("key"), train_on.alias("train"), seq.alias("s"), F.monotonically_increasing_id().alias("row")), "rows")
    part = lambda i: F.when(F.col("pos") >= i, F.element_at("s", F.greatest(F.col("pos") - i + 1, F.lit(1))))
    t = rows.select("key", "train", "row", "s", F.posexplode("s").alias("pos", "w")).select("key", "train", "row", "w", part(1).alias("v"), part(2).alias("u"))
    t = staged(t, "tokens")
    uni = t.where("train").groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    frequent = staged(uni, "words")
    total = frequent.where("w.k <> 's'").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    f = lambda name: frequent.select(F.col("w").alias(name), F.col("c").alias(f"c{name}"))
    pairs = t.where("train AND v IS NOT NULL").groupBy("v", "w").agg(F.count(F.lit(1)).alias("c2"))
    quant = lambda p: F.pow(F.lit(2.0), -F.least(F.ceil(-8 * F.log2(F.greatest(p, F.lit(1e-12))) - 1e-9), F.lit(255)) / 8)
    pairs = staged(pairs.join(f("v"), "v").withColumn("p2", quant((F.col("c2") - DISCOUNT) / F.col("cv"))).drop("cv"), "pairs")
    rest2 = pairs.groupBy("v").agg(quant(F.greatest(1 - F.sum("p2"), F.lit(1e-9))).alias("r2"))
    triples = t.where("train AND u IS NOT NULL").groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c3"))
    context = pairs.select(F.col("v").alias("u"), F.col("w").alias("v"), F.col("c2").alias("cuv"))
    triples = staged(triples.join(context, ["u", "v"]).withColumn("p3", quant((F.col("c3") - DISCOUNT) / F.col("cuv"))).select("u", "v", "w", "p3"), "triples")
    rest3 = triples.groupBy("u", "v").agg(quant(F.greatest(1 - F.sum("p3"), F.lit(1e-9))).alias("r3"))
    e = t.where("w.k <> 's'").join(f("w"), "w", "left").join(pairs.select("v", "w", "p2"), ["v", "w"], "left").join(rest2, "v", "left").join(triples, ["u", "v", "w"], "left").join(rest3, ["u", "v"], "left")
    low = (F.coalesce("cw", F.lit(0)) + 1) / (total.n + total.v + 1)
    zero, one = F.lit(0.0), F.lit(1.0)
    p = F.coalesce("p3", zero) + F.coalesce("r3", one) * (F.coalesce("p2", zero) + F.coalesce("r2", one) * low)
    out = e.groupBy("row", "key").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((F.coalesce("cw", F.lit(0)) > 0).cast("long")).alias("n_known"), F.sum(F.log10(low)).alias("base_score"), F.sum(F.log10(p)).alias("score"))
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    level = word_shards(docs, ~held)
    words = save(_whole(level)[0]) if _small(level) else level
    free()
    got = sharded_scores(docs, ~held, words)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
