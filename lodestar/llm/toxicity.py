"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

Units are words and runs of single letters (s p e l t  o u t). The kernel counts
common subsequences of three letters, each weighted by DECAY to the power of the
length that it spans, up to SPAN positions; digits, marks and inserted symbols are
no letters, and however many of them follow each other take one position, so gapped
and padded insults stay near their plain forms. Letters of any script count: Latin
ones by their base letter, triples of others by a hash. Landmarks give the Nystrom
map; a linear machine is trained in it. Both are linear in the subsequences, so
scoring a unit sums one weight for each.

Training is by labelled sentences of many instances: a toxic document's witness
is the unit that its label explains best, at first by letter four-grams that
toxic documents have and others lack, then by the machine itself; units of other
documents are negatives, those that score highest come in again. A document
scores as its highest unit, mapped to 0..1 by logistic regression.

Labels are fitted on at most TOXIC and CLEAN labelled rows, those of least
digests, of which executors send the distinct units of UNIT symbols; in each of the
three rounds NEGATIVES of the clean documents' units, drawn evenly, and the HARD ones
of highest score are negatives. Scoring covers every whole text and all its units.

Edge cases: null and empty texts, and texts without letters, score as a document
whose units say nothing; repeated rows score alike, rows that share a key or have
none each for themselves (a null key isn't held out); without toxic or without clean
labels, all score 0; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, slices, table, tidy, word_hashes, word_spans

#: Most labelled documents of each kind that the machine is fitted on.
TOXIC, CLEAN = 1600, 2400
#: Landmarks, the weight of a position, positions a subsequence may span.
LANDMARKS, DECAY, SPAN = 192, 0.6, 5
CUT = 0.3
#: Symbols of the units that are fitted, least and most; negatives of a round, and the hard ones that each round adds.
UNIT, NEGATIVES, HARD = (3, 48), 6000, 1500
#: Weights: triples of Latin letters have one each, others share as many.
TABLE = 1 << 16
_OTHER = 227
_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]
_SEP = 255


def _symbols() -> np.ndarray:
    """Letters by their base letter 1..26, other letters from 27 on, white space _SEP, the rest 0."""
    out = np.zeros(0x3000, np.uint8)
    for c in range(len(out)):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if c in (9, 10, 11, 12, 13, 32):
            out[c] = _SEP
        elif "a" <= base <= "z":
            out[c] = ord(base) - 96
        elif base.isalpha():
            out[c] = 27 + c % _OTHER
    return out


SYMBOL = _symbols()


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, starts, ends and document of each unit of UTF-8 texts."""
    raw = data[off[0] : off[-1]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off - off[0]]
    sym = np.where(cp < len(SYMBOL), SYMBOL[np.minimum(cp, len(SYMBOL) - 1)], 27 + cp % _OTHER).astype(np.uint8)
    # marks behind a mark of the same text take no position
    again = (sym[1:] == 0) & (sym[:-1] == 0)
    if again.any():
        keep = np.concatenate([[True], ~again])
        keep[at[:-1][at[:-1] < len(sym)]] = True
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        sym = sym[keep]
    sep = np.zeros(256, bool)
    sep[_SEP] = True
    starts, ends, first = word_spans(sym, at, sep)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    # runs of at least three words of one letter in a document are a unit too
    letters = np.concatenate([[0], np.cumsum((sym > 0) & (sym != _SEP))])
    one = (letters[ends] - letters[starts] == 1) & (ends - starts <= 2)
    if one.any():
        step = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8)))
        runs = [(a, b) for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True) if b - a >= 3]
        cut = [(a + x, a + y) for a, b in runs for x, y in _pieces(doc[a:b]) if y - x >= 3]
        if cut:  # their letters are put behind the text, closed up
            a, b = np.array(cut).T
            more = [s[(s > 0) & (s != _SEP)] for s in (sym[x:y] for x, y in zip(starts[a], ends[b - 1], strict=True))]
            end = len(sym) + np.cumsum([len(m) for m in more])
            starts, ends, doc = np.concatenate([starts, np.concatenate([[len(sym)], end[:-1]])]), np.concatenate([ends, end]), np.concatenate([doc, doc[a]])
            sym = np.concatenate([sym, *more])
    return np.where(sym == _SEP, 0, sym), starts, ends, doc


def _pieces(doc: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def ragged(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of spans one after another, and the span of each."""
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(size)), size)
    return sym[np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(starts, size)], own


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place of three letters in the table of weights."""
    latin = a * 1024 + b * 32 + c
    other = (a > 26) | (b > 26) | (c > 26)
    if not other.any():
        return latin
    h = (a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64) << np.uint64(8) | c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(other, TABLE // 2 + (h >> np.uint64(49)).astype(np.int32), latin)


def subsequences(flat_: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Unit, feature and weight of the subsequences of three letters, for each shape of gaps."""
    letter, s = flat_ > 0, flat_.astype(np.int32)
    for a, b in _PAIRS:
        if len(s) <= b:
            continue
        ok = np.flatnonzero((own[:-b] == own[b:]) & letter[:-b] & letter[b:] & letter[a : len(s) - b + a])
        yield own[ok], triple(s[ok], s[ok + a], s[ok + b]), DECAY ** (b + 1)


def decide(theta: np.ndarray, bias: float, flat_: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The machine's value of each of n units; a unit without subsequences has the bias."""
    value, norm = np.zeros(n), np.zeros(n)
    for u, f, w in subsequences(flat_, own):
        value += np.bincount(u, weights=theta[f] * w, minlength=n)
        norm += np.bincount(u, minlength=n) * w * w
    return value / np.sqrt(np.maximum(norm, 1e-12)) + bias


def matrix(words: list[bytes]) -> np.ndarray:
    """Normalised subsequence vectors of words (bytes of symbols)."""
    size = np.array([len(w) for w in words])
    flat_ = np.frombuffer(b"".join(words), np.uint8)
    own = np.repeat(np.arange(len(words)), size)
    out = np.zeros((len(words), TABLE), np.float32)
    norm = np.zeros(len(words))
    for u, f, w in subsequences(flat_, own):
        np.add.at(out, (u, f), w)
        norm += np.bincount(u, minlength=len(words)) * w * w
    return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]


def _distinct(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of the equal units, and the class of each."""
    order = np.argsort(starts, kind="stable")
    h = np.empty(len(starts), np.uint64)
    size = ends - starts
    # units may overlap, so hashes are made over their symbols one after another
    flat_, _ = ragged(sym, starts[order], ends[order])
    end = np.cumsum(size[order])
    h[order] = word_hashes(flat_, end - size[order], end)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return first, inverse


def _padded(words: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Variants with inserted symbols and letters."""
    out = []
    for w in words:
        if len(w) < 4:
            continue
        out.append(b"\0".join(w[i : i + 1] for i in range(len(w))))
        for filler in (0, 0, *rng.integers(1, 27, 3).tolist()):
            k = int(rng.integers(1, len(w)))
            out.append(w[:k] + bytes([filler]) + w[k:])
        for k in rng.integers(0, len(w), 2).tolist():
            out.append(w[:k] + w[k : k + 1] + w[k:])
    return out


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: float = 2e-3) -> tuple[np.ndarray, float]:
    """Squared hinge loss by accelerated gradient steps; y is -1 or 1."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(x1.shape[1])
    weight = weight / weight.sum()
    top = np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2
    rate = 1 / (2 * top + ridge)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (weight * y * slack) + ridge * np.append(v[:-1], 0)
        new = v - rate * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def bags(data: np.ndarray, off: np.ndarray) -> list[list[bytes]]:
    """The distinct units of UNIT symbols of each text, without marks at their ends."""
    out: list[list[bytes]] = []
    for i, j in slices(off):
        sym, starts, ends, doc = units(data, off[i : j + 1])
        size = ends - starts
        on = (size >= UNIT[0]) & (size <= UNIT[1])
        starts, ends, doc = starts[on], ends[on], doc[on]
        raw = sym.tobytes()
        order = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[order], np.arange(j - i + 1))
        for d in range(j - i):
            own = order[cut[d] : cut[d + 1]]
            words = {raw[s:e].strip(b"\0") for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)}
            out.append(sorted(w for w in words if len(w) >= UNIT[0]))
    return out


def fit(texts: list[str | None], toxic: list[int], seed: int = 5) -> tuple[np.ndarray, float, float, float]:
    """Weights of subsequences, bias, and slope and offset of the logistic map."""
    return fit_units(bags(*flat(pa.array([t or "" for t in texts], pa.large_string()))), toxic, seed)


def fit_units(docs: list[list[bytes]], toxic: list[int], seed: int = 5) -> tuple[np.ndarray, float, float, float]:
    """fit() of the distinct units of each document."""
    zero = np.zeros(TABLE), 0.0, 0.0, -30.0
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        return zero
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    bags = [np.array([known.setdefault(w, len(known)) for w in own], np.int64) for own in docs]
    words = list(known)
    have, lack = np.zeros(1 << 21), np.zeros(1 << 21)
    if not words:
        return zero
    size = np.array([len(w) for w in words])
    flat_ = np.frombuffer(b"".join(words), np.uint8)
    own = np.repeat(np.arange(len(words)), size)
    s = flat_.astype(np.int64)
    four = (s[:-3] << 15) | (s[1:-2] << 10) | (s[2:-1] << 5) | s[3:]
    other = (flat_[:-3] > 26) | (flat_[1:-2] > 26) | (flat_[2:-1] > 26) | (flat_[3:] > 26)
    wide = ((s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    four = np.where(other, (1 << 20) + (wide >> np.uint64(44)).astype(np.int64), four)
    inside = np.flatnonzero((own[:-3] == own[3:]) & (flat_[:-3] > 0) & (flat_[1:-2] > 0) & (flat_[2:-1] > 0) & (flat_[3:] > 0))
    where = np.searchsorted(own[inside], np.arange(len(words) + 1))
    for bag, bad in zip(bags, y, strict=True):
        if len(bag):
            got = np.unique(np.concatenate([four[inside[where[w] : where[w + 1]]] for w in bag.tolist()]))
            (have if bad else lack)[got] += 1
    odds = np.log((have + 0.2) / (y.sum() + 1)) - np.log((lack + 0.2) / ((~y).sum() + 1))
    odds[have < 3] = 0
    best = np.zeros(len(words))
    np.maximum.at(best, own[inside], odds[four[inside]])
    clean = np.unique(np.concatenate([b for b, bad in zip(bags, y, strict=True) if not bad] or [np.zeros(0, np.int64)]))
    is_clean = np.zeros(len(words), bool)
    is_clean[clean] = True
    best[is_clean] = np.minimum(best[is_clean], 0)
    value, floor = best, 2.0
    theta, bias = zero[0], 0.0
    hard = np.zeros(0, np.int64)
    for _ in range(3):
        witness = [int(b[np.argmax(value[b])]) for b, bad in zip(bags, y, strict=True) if bad and len(b)]
        witness = np.array([w for w in witness if value[w] > floor and not is_clean[w]], np.int64)
        if not len(witness) or not len(clean):
            return zero
        pos, times = np.unique(witness, return_counts=True)
        neg = np.unique(np.concatenate([rng.choice(clean, min(len(clean), NEGATIVES), replace=False), hard]))
        land = np.concatenate([pos[np.argsort(-times)][: LANDMARKS // 2], rng.choice(neg, min(len(neg), LANDMARKS // 2), replace=False)])
        phi = matrix([words[i] for i in land])
        vals, vecs = np.linalg.eigh((phi @ phi.T).astype(np.float64) + 1e-4 * np.eye(len(land)))
        root = vecs / np.sqrt(np.maximum(vals, 1e-4)) @ vecs.T
        bank = [words[i] for i in pos]
        more = _padded(bank, rng)
        def embed(group: list[bytes], phi: np.ndarray = phi, root: np.ndarray = root) -> np.ndarray:
            return np.concatenate([matrix(group[i : i + 100]) @ phi.T @ root for i in range(0, len(group), 100)])
        x = np.concatenate([embed(bank), embed(more), embed([words[i] for i in neg])])
        label = np.concatenate([np.ones(len(bank) + len(more)), -np.ones(len(neg))])
        weight = np.concatenate([np.sqrt(times) / np.sqrt(times).sum() * 0.6, np.full(len(more), 0.4 / max(1, len(more))), np.full(len(neg), 2.0 / len(neg))])
        w, bias = _train(x, label, weight)
        theta = phi.T.astype(np.float64) @ (root @ w)
        value, floor = decide(theta, bias, flat_, own, len(words)), 0.0
        hard = np.unique(np.concatenate([hard, clean[np.argsort(-value[clean])[:HARD]]]))
    top = np.array([value[b].max() if len(b) else bias for b in bags])
    a, c = 1.0, 0.0
    for _ in range(60):  # logistic regression on the highest unit, by Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * top + c, -30, 30)))
        g = np.array([((p - y) * top).sum() + 1e-2 * a, (p - y).sum() + 1e-3 * c])
        v = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * top * top).sum() + 1e-2, (v * top).sum()], [(v * top).sum(), v.sum() + 1e-3]])
        da, dc = np.linalg.solve(h, g)
        a, c = a - np.clip(da, -2, 2), c - np.clip(dc, -2, 2)
    return theta, bias, float(a), float(c)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[list, list]:
    """Distinct units and labels of at most TOXIC and CLEAN labelled texts whose row is for training, of the least digests."""
    marked = labels.where((F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) != 2) & F.col("toxic").isNotNull()).select(F.col(key).alias("key"), "toxic")
    draw = F.xxhash64(F.col("key").cast("string"), F.lit("toxicity"))
    picked = [marked.where(F.col("toxic") == v).orderBy(draw, "key").limit(n) for v, n in ((1, TOXIC), (0, CLEAN))]
    own = F.broadcast(picked[0].union(picked[1]))  # TOXIC + CLEAN rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = bags(*flat(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes([_SEP]).join(g) for g in got], pa.binary())], names=["order", "toxic", "units"])

    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(own, "key").select(F.xxhash64("key", "text").alias("order"), F.col("toxic").cast("int").alias("toxic"), "text")
    got = read.mapInArrow(tidy(run), "order long, toxic int, units binary").orderBy("order", "toxic", "units").toArrow()
    return [u.as_py().split(bytes([_SEP])) if u.as_py() else [] for u in got.column("units")], got.column("toxic").to_pylist()


def scored(docs: DataFrame, machine: tuple[np.ndarray, float, float, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and the number of units over the machine's margin, for each row."""
    sent = docs.sparkSession.sparkContext.broadcast((machine[0].astype(np.float32), *machine[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta, bias, a, c = sent.value
        for batch in batches:
            data, off = flat(batch.column(1))
            top, over = np.full(batch.num_rows, bias), np.zeros(batch.num_rows, np.int64)
            for i, j in slices(off):
                sym, starts, ends, doc = units(data, off[i : j + 1])
                if not len(starts):
                    continue
                first, inverse = _distinct(sym, starts, ends)
                value = decide(theta, bias, *ragged(sym, starts[first], ends[first]), len(first))[inverse]
                np.maximum.at(top, doc + i, value)
                over += np.bincount(doc[value > 0] + i, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(a * top + c, -30, 30)))), pa.array(over)], names=[key, "score", "n_toxic_units"])

    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {docs.schema[key].dataType.simpleString()}, score double, n_toxic_units long")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit_units(*sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
