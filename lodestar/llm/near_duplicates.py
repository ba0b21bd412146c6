"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents of equal shingle sets are one class, known by a 64-bit digest. Small
sets (up to a boundary chosen by cost) enumerate fixed-size subsets, the pairs
of the first tokens of their sets; sets that can meet a large one post the first
tokens to inverted lists, which are scanned. The order of tokens, the same for
all sets, has light tokens first and heavy ones (in many sets) last by their
frequency, so a passage that many documents share makes long lists only for
documents that consist of such passages. A list of up to PAIRS members gives its
pairs, a longer one links its members to one of them at first, and pairs across
components are met afterwards only: in blocks of members, so that a large list is
dealt over many tasks, and by sketches, so that hardly a pair that doesn't link is
made. Every pair is verified by its whole sets of 64-bit shingle hashes.

A pair's number of shared first tokens bounds its intersection, which drops most
pairs before verification; no bound drops a pair that links.

Edge cases: null and empty texts, or texts without words, have empty sets and
link with nothing; fewer than five words are one shingle; rows that repeat are
links of one class; rows without a key link like others, and a component's name is
its least key that isn't null (null if it has none); rows that share a key are
looked at one by one; an empty table gives an empty result. Other columns are not
read, and pass through deduplicated() whatever their names. Digests of 64 bits merge
two different sets with a chance of about n^2/2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER, bounded_broadcast, counted, flat, free, mix, pack, scratch, shard_bounds, shards, shingle_hashes, slices, table, tidy, tidy_group, unpack, without, word_hashes, word_spans
from .components import components

K = 5
#: Links need 100 * intersection >= 80 * union.
NUM, DEN = 4, 5
#: A list of so many members at most gives its pairs at once.
PAIRS = 8
#: Tokens in more sets than the threshold are heavy; it rises from the first value until their list fits.
HEAVY_FROM, HEAVY_MOST = 16, 1 << 20
#: Boundaries between small and large sets that are weighed.
BOUNDARIES = (4, 8, 12, 16, 24, 32, 48, 64)
#: Rows up to which links or documents to fetch are broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1 << 19
#: 64-bit words of a sketch.
WORDS = 16
#: Most turns in which long lists link their members to a drawn one, before all remaining pairs are met.
TURNS = 6
#: Members of a long list that are one block where all remaining pairs are met.
MEMBERS = 1024
#: Postings a task gathers before it deals them out.
GATHER = 1 << 20
_SUB = np.uint64(0xD1342543DE82EF95)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written and read back on little disk, as dozens of tables and their shuffle files would add up."""
    return common.staged(df, name, small=True)


def least_overlap(n: int) -> int:
    """What a set of n tokens must share with any set that it links with."""
    return -(-NUM * n // DEN)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; off starts at 0."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    every = shingle_hashes(words, k) if len(words) >= k else words
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - k + 1]) if b - a >= k else shingle_hashes(words[a:b], k))
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, off = flat(batch.column(1))
    for i, j in slices(off):
        for d, s in enumerate(shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)):
            yield i + d, s


def digest(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many tokens fall on each of 64 * WORDS places: two sets differ in as many tokens, at least, as their sketches in bits."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _differ(a: str, b: str) -> F.Column:
    """In how many bits two sketches differ."""
    total = F.lit(0)
    for i in range(WORDS):
        total = total + F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}")))
    return total


def classes(docs: DataFrame, key: str, text: str, k: int = K) -> DataFrame:
    """key, text_digest, n_shingles, the digest of its set (null if empty) and its sketch for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), digest(s), sketch(s)) for _, s in _sets(batch, k)]
            words = np.concatenate([g[2] for g in got]).reshape(-1, WORDS) if got else np.zeros((0, WORDS), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], names=["key", "text_digest", "n", "node", *(f"s{i}" for i in range(WORDS))])

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(tidy(run), f"key {docs.schema[key].dataType.simpleString()}, text_digest long, n long, node long, " + ", ".join(f"s{i} long" for i in range(WORDS)))


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _deal(n: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Postings sorted by key, a row for each shard that has any."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    b = shard_bounds(keys, n)
    own = np.flatnonzero(np.diff(b))
    cut = [slice(b[s], b[s + 1]) for s in own.tolist()]
    blobs = [pa.array([pack(keys[c] >> np.uint64(16)) for c in cut], pa.binary())] + [pa.array([_planes(a[c]) for c in cut], pa.binary()) for a in columns]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *blobs], names=["shard", "keys", *(f"c{i}" for i in range(len(columns)))])


def heavy_tokens(docs: DataFrame, text: str, k: int) -> DataFrame:
    """Tokens (48 bits) in more than HEAVY_FROM sets, packed by shard, with in how many.

    Counted over the least hashes of each set, twice as many as its prefix has:
    a token further back comes into a prefix only by way of heavy ones before it.
    """
    n = shards(docs.sparkSession, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, s in _sets(batch, k):
                if len(s) < 4 or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                held.append(s[: 2 * (len(s) - least_overlap(len(s)) + 1)])
                size += len(held[-1])
                if size >= GATHER:
                    keys, c = counted(np.concatenate(held) >> np.uint64(16))
                    yield _deal(n, keys << np.uint64(16), [c.astype("<u4")])
                    held, size, seen = [], 0, set()
        if held:
            keys, c = counted(np.concatenate(held) >> np.uint64(16))
            yield _deal(n, keys << np.uint64(16), [c.astype("<u4")])

    def add(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py()) for x in group.column("keys")])
        c = np.concatenate([_unplanes(x.as_py(), "<u4") for x in group.column("c0")])
        keys, c = counted(keys, c)
        big = c > HEAVY_FROM
        return pa.table({"keys": pa.array([keys[big].tobytes()], pa.binary()), "df": pa.array([c[big].astype("<u4").tobytes()], pa.binary()), "levels": pa.array([[int((c > (HEAVY_FROM << i)).sum()) for i in range(24)]], pa.list_(pa.int64()))})

    dealt = docs.select(F.lit(0).alias("key"), text).mapInArrow(tidy(run), "shard int, keys binary, c0 binary")
    return dealt.groupBy("shard").applyInArrow(tidy_group(add), "keys binary, df binary, levels array<long>")


def _heavy_list(found: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Heavy tokens over the least threshold at which HEAVY_MOST hold them all."""
    levels = found.select(F.posexplode("levels")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    at = next((r.pos for r in levels if r.n <= HEAVY_MOST), 23)
    least = HEAVY_FROM << at

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, df in zip(batch.column("keys"), batch.column("df"), strict=True):
                keys, df = np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(df.as_py(), np.uint32)
                on = df > least
                yield pa.RecordBatch.from_arrays([pa.array([keys[on].tobytes()], pa.binary()), pa.array([df[on].tobytes()], pa.binary())], names=["keys", "df"])

    got = found.mapInArrow(tidy(keep), "keys binary, df binary").toArrow()
    keys = np.frombuffer(b"".join(got.column("keys").to_pylist()), np.uint64)
    df = np.frombuffer(b"".join(got.column("df").to_pylist()), np.uint32)
    order = np.argsort(keys)
    return keys[order], df[order], least


def boundary(known: DataFrame, list_length: float) -> int:
    """The boundary of least cost: subsets of small sets against postings times the lists that they scan."""
    top = 2 * max(BOUNDARIES)
    sizes = {r.n: r.c for r in known.where(F.col("n").between(4, top)).groupBy("n").agg(F.count_distinct("node").alias("c")).collect()}

    def cost(b: int) -> float:
        subsets = sum(c * comb(n - least_overlap(n) + 2, 2) for n, c in sizes.items() if n <= b)
        return subsets + sum(c * (n - least_overlap(n) + 1) * list_length for n, c in sizes.items() if n * DEN // NUM > b)

    return min(BOUNDARIES, key=cost)


def postings(docs: DataFrame, text: str, k: int, sent: Broadcast, small: int) -> DataFrame:
    """Subset keys of small sets and first tokens of the others, dealt by key, with node, size and what follows.

    What follows a token in its set's order (itself included) bounds the intersection
    of a pair whose first common token it is.
    """
    n = shards(docs.sparkSession, docs)

    def keys_of(s: np.ndarray, hk: np.ndarray, hdf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(hk):
            at = np.searchsorted(hk, s >> np.uint64(16))
            at[at == len(hk)] = 0
            is_heavy = hk[at] == s >> np.uint64(16)
            if is_heavy.any():
                back = s[is_heavy]
                s = np.concatenate([s[~is_heavy], back[np.lexsort((back, hdf[at[is_heavy]]))]])
        m, o = len(s), least_overlap(len(s))
        out = []
        if m <= small:
            head = s[: m - o + 2]
            i, j = np.triu_indices(len(head), 1)
            a, b = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
            out.append((mix(a * _SUB + mix(b)), np.full(len(a), m)))
        if m * DEN // NUM > small:
            out.append((s[: m - o + 1], m - np.arange(m - o + 1)))
        return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hk, hdf = sent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def deal() -> pa.RecordBatch:
            each = np.array([len(h[0]) for h in held])
            return _deal(n, np.concatenate([h[0] for h in held]), [np.repeat(np.array([h[2] for h in held], np.int64), each), np.repeat(np.array([h[3] for h in held], "<u4"), each), np.concatenate([h[1] for h in held]).astype("<u4")])

        for batch in batches:
            for _, s in _sets(batch, k):
                if len(s) < 4 or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                held.append((*keys_of(s, hk, hdf), d, len(s)))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield deal()
                    held, size, seen = [], 0, set()
        if held:
            yield deal()

    return docs.select(F.lit(0).alias("key"), text).mapInArrow(tidy(run), "shard int, keys binary, c0 binary, c1 binary, c2 binary")


def lists(dealt: DataFrame) -> DataFrame:
    """What the lists of each shard give.

    kind 0: pairs (x, y) of short lists with how many lists have them; kind 1:
    the members (x: list, y: node) of longer lists; kind 2: in how many longer
    lists a node (x) is. nx, ny: sizes. follow: of a pair, whether it passes in one
    of its lists; of a member, what follows in its set.
    """

    def scan(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(v.as_py()) for v in group.column("keys")])
        node = np.concatenate([_unplanes(v.as_py(), "<i8") for v in group.column("c0")])
        size = np.concatenate([_unplanes(v.as_py(), "<u4") for v in group.column("c1")]).astype(np.int64)
        rest = np.concatenate([_unplanes(v.as_py(), "<u4") for v in group.column("c2")]).astype(np.int64)
        order = np.lexsort((node, keys))
        keys, node, size, rest = keys[order], node[order], size[order], rest[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, node, size, rest = keys[new], node[new], size[new], rest[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        count = np.diff(np.append(first, len(keys)))
        xs, ys, nxs, nys, oks = [], [], [], [], []
        for c in range(2, PAIRS + 1):
            at = first[count == c]
            for i in range(c):
                for j in range(i + 1, c):
                    xs.append(node[at + i]), ys.append(node[at + j]), nxs.append(size[at + i]), nys.append(size[at + j])
                    oks.append(9 * np.minimum(rest[at + i], rest[at + j]) >= 4 * (size[at + i] + size[at + j]))
        empty = np.zeros(0, np.int64)
        x, y, nx, ny, ok = (np.concatenate(a).astype(np.int64) if a else empty for a in (xs, ys, nxs, nys, oks))
        near = (DEN * nx >= NUM * ny) & (DEN * ny >= NUM * nx)
        x, y, nx, ny, ok = x[near], y[near], nx[near], ny[near], ok[near]
        order = np.lexsort((y, x))
        x, y, nx, ny, ok = x[order], y[order], nx[order], ny[order], ok[order]
        start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, int)
        hits = np.diff(np.append(start, len(x)))
        ok = np.maximum.reduceat(ok, start) if len(x) else ok
        x, y, nx, ny = x[start], y[start], nx[start], ny[start]
        big = np.flatnonzero(count > PAIRS)
        # longer lists of the same members are one list, in which each member has most to follow
        signs: dict[int, int] = {}
        for b in big.tolist():
            own = slice(first[b], first[b] + count[b])
            was = signs.setdefault(xxhash.xxh3_64_intdigest(node[own].tobytes()) - (1 << 63), b)
            one = slice(first[was], first[was] + count[was])
            rest[one] = np.maximum(rest[one], rest[own])
        member = [np.arange(first[b], first[b] + count[b]) for b in signs.values()]
        gid = np.repeat(np.array(list(signs), np.int64), [len(m) for m in member]) if member else empty
        member = np.concatenate(member) if member else empty
        every = np.concatenate([np.arange(first[b], first[b] + count[b]) for b in big.tolist()]) if len(big) else empty
        inside, times = np.unique(node[every], return_counts=True)
        zero = np.zeros
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1, 2], [len(x), len(gid), len(inside)]), pa.int32()),
                "x": np.concatenate([x, gid, inside]).astype(np.int64),
                "y": np.concatenate([y, node[member], zero(len(inside), np.int64)]).astype(np.int64),
                "nx": np.concatenate([nx, zero(len(gid), np.int64), zero(len(inside), np.int64)]).astype(np.int64),
                "ny": np.concatenate([ny, size[member], zero(len(inside), np.int64)]).astype(np.int64),
                "hits": np.concatenate([hits, zero(len(gid), np.int64), times]).astype(np.int64),
                "follow": np.concatenate([ok, rest[member], zero(len(inside), np.int64)]).astype(np.int64),
            }
        )

    return dealt.groupBy("shard").applyInArrow(tidy_group(scan), "kind int, x long, y long, nx long, ny long, hits long, follow long")


def verified(pairs: DataFrame, pool: DataFrame, text: str, k: int) -> DataFrame:
    """Those of pairs (x, y) whose whole sets link. pool: node and a text that has its set."""
    pairs = staged(pairs.select("x", "y").distinct(), "pairs")
    need = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    own = pool.join(bounded_broadcast(staged(need, "need"), BROADCAST_ROWS), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, bytes]] = []
            for _, s in _sets(batch, k):
                held.append((digest(s), pack(s)))
                if len(held) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["node", "set"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["node", "set"])

    # repeated rows of a document would give a set twice; that only repeats a link
    sets = own.select("node", text).mapInArrow(tidy(run), "node long, set binary")
    right = sets.join(bounded_broadcast(pairs, BROADCAST_ROWS), F.col("node") == F.col("y")).select("x", "y", F.col("set").alias("sy"))
    left = sets.join(bounded_broadcast(pairs.select(F.col("x").alias("node")).distinct(), BROADCAST_ROWS), "node", "left_semi")
    both = right.join(left.select(F.col("node").alias("x"), F.col("set").alias("sx")).hint("merge"), "x")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, a = [], None, None
            for x, sx, sy in zip(batch.column("x").to_pylist(), batch.column("sx"), batch.column("sy"), strict=True):
                if x != last:
                    last, a = x, unpack(sx.as_py())
                b = unpack(sy.as_py())
                both = np.sort(np.concatenate([a, b]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * shared >= NUM * (len(both) - shared))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return both.select("x", "y", "sx", "sy").mapInArrow(tidy(test), "x long, y long").distinct()


def _components(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, text_digest, n and comp (null for an empty set) of each row of docs."""
    known = staged(classes(docs, key, text, k), "classes")
    cols = [f"s{i}" for i in range(WORDS)]
    one = known.where("n >= 4").groupBy("node").agg(F.min(F.struct("key", "text_digest", "n", *cols)).alias("o")).select("node", "o.*")
    one = staged(one, "nodes")
    found = staged(heavy_tokens(docs, text, k), "tokens")
    hk, hdf, least = _heavy_list(found)
    small = boundary(known, 1.0 + least / 4)
    sent = docs.sparkSession.sparkContext.broadcast((hk, hdf))
    del hk, hdf
    got = staged(lists(postings(docs, text, k, sent, small)), "lists")
    sent.destroy()
    free()
    long = got.where("kind = 1").groupBy(F.col("x").alias("gid"), F.col("y").alias("node")).agg(F.max("ny").alias("n"), F.max("follow").alias("follow"))
    long = staged(long, "long")
    in_long = got.where("kind = 2").groupBy(F.col("x").alias("node")).agg(F.sum("hits").alias("more"))
    pairs = got.where("kind = 0").groupBy("x", "y").agg(F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.sum("hits").alias("hits"), F.max("follow").alias("follow")).where("follow > 0")
    # shared first tokens (also those in longer lists) and the rest of the set bound the intersection
    pairs = pairs.join(in_long.withColumnsRenamed({"node": "x", "more": "mx"}), "x", "left").join(in_long.withColumnsRenamed({"node": "y", "more": "my"}), "y", "left")
    need = F.ceil(F.lit(4) * (F.col("nx") + F.col("ny")) / 9)
    bound = F.col("hits") + F.least(F.coalesce("mx", F.lit(0)), F.coalesce("my", F.lit(0))) + F.ceil(F.greatest("nx", "ny") * F.lit(NUM) / DEN) - 1
    pairs = pairs.where((F.greatest("nx", "ny") <= small) | (bound >= need)).select("x", "y")

    side = lambda c: one.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), *(F.col(v).alias(f"{c}{v}") for v in cols))
    close = lambda a, b: 9 * _differ(f"{a}s", f"{b}s") <= F.col(f"n{a}") + F.col(f"n{b}")
    likely = lambda p: p.select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y").where(close("x", "y")).select("x", "y")
    pairs = staged(likely(pairs), "candidates")
    # the texts that pairs may ask for, one for each set, by key and digest as keys may repeat or be null
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).union(long.select("node")).distinct()
    where = bounded_broadcast(staged(one.select("node", "key", "text_digest").join(asked, "node", "left_semi"), "fetch"), BROADCAST_ROWS)
    pool = docs.select(F.col(key).alias("own"), F.col(text).alias("text"))
    pool = staged(pool.join(where, F.col("own").eqNullSafe(F.col("key")) & (F.xxhash64("text") == F.col("text_digest"))).select("node", "text"), "pool")

    def check(p: DataFrame, sketched: bool = False) -> DataFrame:
        """Sketches first, which drop no link, then whole sets."""
        return staged(verified(p if sketched else likely(p), pool, "text", k), "verified")

    # first each node with its least partner, and the members of a long list with one of them
    first = pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")
    fits = (DEN * F.col("n") >= NUM * F.col("nx")) & (DEN * F.col("nx") >= NUM * F.col("n")) & (9 * F.least("follow", "fx") >= 4 * (F.col("n") + F.col("nx")))
    # a row for each list; where these are too many to send, a list with very many members is a skewed join, which Spark splits
    of_lists = lambda df: bounded_broadcast(staged(df, "of-lists"), BROADCAST_ROWS)
    pivot = of_lists(long.groupBy("gid").agg(F.min(F.struct("node", "n", "follow")).alias("p")).select("gid", F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("p.follow").alias("fx")))
    star = long.join(pivot, "gid").where((F.col("node") != F.col("x")) & fits).groupBy(F.col("node").alias("y")).agg(F.min("x").alias("x")).select("x", "y")
    links = check(first.union(star))
    turn, last = 0, False
    while True:
        with scratch(docs.sparkSession) as kept:  # of a turn only its links stay
            comp = components(links)
            label = lambda df, c, comp=comp: df.join(comp.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", F.col(c)))
            members = staged(label(long, "node").withColumnRenamed("cnode", "comp"), "members")
            # only lists whose members are in several components can still link
            open_ = of_lists(members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("gid", "m"))
            left = staged(members.join(open_, "gid"), "open")
            if not last:
                # one member of each list, another each turn, draws in those near it: a large group of copies needs no pairs
                draw = F.min(F.struct(F.xxhash64("node", "gid", F.lit(turn)), "node", "n", "follow", "comp")).alias("p")
                pivot = of_lists(left.groupBy("gid").agg(draw).select("gid", F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("p.follow").alias("fx"), F.col("p.comp").alias("cx")))
                new = check(left.join(pivot, "gid").where((F.col("comp") != F.col("cx")) & fits).select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")))
            else:
                rest = label(label(pairs, "x"), "y").where("cx <> cy").select("x", "y")
                # blocks of a list's members: the one side is dealt to them, the other is copied to each
                n_blocks = F.ceil(F.col("m") / F.lit(MEMBERS)).cast("int")
                a, b = (left.select("gid", "m", F.col("node").alias(c), F.col("follow").alias(f"f{c}"), F.col("comp").alias(f"c{c}")).join(side(c), c) for c in "xy")
                a = a.withColumn("block", F.pmod(F.xxhash64("x"), n_blocks).cast("int")).drop("m")
                b = b.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).drop("m")
                across = a.join(b, ["gid", "block"]).where((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (DEN * F.col("nx") >= NUM * F.col("ny")) & (DEN * F.col("ny") >= NUM * F.col("nx")) & (9 * F.least("fx", "fy") >= 4 * (F.col("nx") + F.col("ny"))) & close("x", "y")).select("x", "y")
                new = check(rest.union(across), True)
            links = kept(links.union(new), "links", small=True)
            if last:
                break
            turn += 1
            last = turn == TURNS or new.count() <= left.count() // 100
    comp = components(links)
    return known.select("key", "text_digest", "n", "node").join(comp, "node", "left").select("key", "text_digest", "n", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, n_shingles, component_id (the least key of its component) for each row of docs."""
    with scratch(docs.sparkSession) as kept:
        named = staged(_components(docs, key, text, k), "named")
        least_key = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("key").alias("first"))
        return kept(named.join(least_key, "comp", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "key").alias("component_id")), "near-duplicates", small=True)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """docs with one row of each component: the one of least key (rows without a key come last), of equal rows one.

    Rows without words are linked with nothing and all stay.
    """
    with scratch(docs.sparkSession) as kept:
        named = staged(_components(docs, key, text, k).where("comp IS NOT NULL"), "named")
        best = named.groupBy("comp").agg(F.min(F.struct(F.col("key").isNull(), "key", "text_digest")).alias("best"))
        gone = named.join(best, "comp").where(~(F.col("key").eqNullSafe(F.col("best.key")) & (F.col("text_digest") == F.col("best.text_digest"))))
        drop = kept(gone.select("key", F.col("text_digest").alias("digest")).distinct(), "dropped", small=True)
        again = named.groupBy("key", "text_digest").count().where("count > 1").limit(1).count()
    out = without(docs, drop, docs[key], F.xxhash64(docs[text]))
    if not again:
        return out
    one = f"one_{'_'.join(docs.columns)}"  # no column of docs is called so
    return out.withColumn(one, F.when(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.monotonically_increasing_id())).dropDuplicates([key, text, one]).drop(one)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
