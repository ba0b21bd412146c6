"""Quality classifier: an interpolated modified Kneser-Ney model of characters for each language.

Counts of ORDER-grams come from all trusted text; lower orders take continuation
counts. Discounts, context totals and interpolated probabilities are made by
joins of count tables that are sharded by their keys. Documents are read in blocks;
a block asks the shards of the tables for its distinct n-grams. The shard of an
n-gram is that of its last two context symbols, as are those of the shorter n-grams
and contexts that interpolate it, so each shard answers by itself; the answers meet
their block's documents, which they score. Only single symbols' probabilities are
sent everywhere (65,536 a model at most), at any size. A document is rejected if its perplexity exceeds its
language's threshold: a quantile over all its trusted documents, each scored by a
model of the other FOLDS - 1 parts of the trusted text. A language with too few
trusted documents for that quantile takes its median and the quantile of all
languages' distances from their medians; one whose documents no other part can
score takes the quantile of all trusted documents.

Edge cases: null and empty texts have perplexity 1 and are kept; a null language
is a language of its own; a language without trusted text has no threshold and
keeps all; every row is judged by its own text, so repeated rows are judged alike
and rows that share an identifier, or have none, each for themselves; an empty table
gives an empty result; extra columns pass through classified(), whatever their
names. Characters over U+FFFB count as one symbol.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, counted, flat, pack, scratch, shards, slices, staged, table, tidy, tidy_pair, unpack, without

ORDER = 4
#: Bytes of text of a block of documents (a longer document is a block of its own).
BLOCK = 8 << 20
#: Rows up to which the trusted identifiers are broadcast.
LABEL_ROWS = 1 << 20
#: Parts of the trusted documents, each scored without itself (10 at most: a digit names one), the thresholds' quantile, and the room above it.
FOLDS, QUANTILE, ROOM = 5, 0.995, 1.02
#: Steps of log10 perplexity by which quantiles are counted.
STEP = 1e-4
_GATHER = 1 << 21


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each symbol of each text (and at its end), and how many each text has."""
    raw = data[off[0] : off[-1]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off - off[0]]
    sizes = np.diff(at)
    filled = sizes > 0
    pad = ORDER - 1
    # each text with content gets ORDER - 1 starts before and one end after it
    n = np.where(filled, sizes + ORDER, 0)
    base = np.concatenate([[0], np.cumsum(n)])
    sym = np.ones(base[-1], np.uint64)  # 1 starts a text, 2 ends it, characters follow
    sym[np.arange(len(cp)) + np.repeat(base[:-1] + pad - at[:-1], sizes)] = np.minimum(cp, 65532) + 3
    sym[base[1:][filled] - 1] = 2
    key = sym.copy()
    for k in range(1, ORDER):
        key[k:] |= sym[:-k] << np.uint64(16 * k)
    keep = np.ones(len(sym), bool)
    for k in range(pad):
        keep[base[:-1][filled] + k] = False
    return key[keep], np.where(filled, sizes + 1, 0)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """Languages (those of all columns between key and text), rows, grams and their number for slices of the texts of each."""
    names = list(zip(*(c.to_pylist() for c in batch.columns[1:-1]), strict=True))
    by: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        by.setdefault(name, []).append(i)
    for name, own in by.items():
        data, off = flat(batch.columns[-1].take(pa.array(own)))
        for i, j in slices(off):
            key, n = grams(data, off[i : j + 1])
            yield name, np.array(own[i:j]), key, n


def counts(docs: DataFrame) -> DataFrame:
    """lang, g, c: how often each ORDER-gram occurs in docs (key, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def out(name: str | None) -> pa.RecordBatch:
            k, c = held.pop(name)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(c)], names=["lang", "g", "c"])

        for batch in batches:
            for (name,), _, key, _ in _by_lang(batch):
                k, c = counted(key)
                if name in held:
                    k, c = counted(np.concatenate([held[name][0], k]), np.concatenate([held[name][1], c]))
                held[name] = (k, c)
                while sum(len(v[0]) for v in held.values()) > _GATHER:  # of all languages and parts together
                    yield out(max(held, key=lambda x: len(held[x][0])))
        for name in list(held):
            yield out(name)

    return docs.select("key", "lang", "text").mapInArrow(tidy(run), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def model(docs: DataFrame) -> DataFrame:
    """lang, kind ('p' or 'b'), n, g, v: probabilities of n-grams, and back-off weights of contexts of n symbols.

    n = 0 of kind 'p' is the even share of a symbol, one that wasn't seen included.
    """
    return model_of(staged(counts(docs), "grams", small=True))


def model_of(level: DataFrame, keep: Callable[..., DataFrame] = staged) -> DataFrame:
    """model() of the counts of ORDER-grams (lang, g, c). keep: writes its tables, each once."""
    parts, weights, lower = [], [], None
    tables = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy("lang", F.col("g").bitwiseAND((1 << 16 * n) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    for n in range(1, ORDER + 1):
        t = tables[n].withColumn("ctx", F.shiftrightunsigned("g", 16) if n > 1 else F.lit(0).cast("long"))
        few = t.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        ratio = lambda k: F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(k / 2)
        few = few.select(F.col("lang").alias("lang_"), *(F.greatest(F.lit(0.05), F.least(ratio(k), F.lit(k - 0.05))).alias(f"d{k}") for k in (1, 2, 3)))
        t = t.join(bounded_broadcast(few, 1 << 14), F.col("lang").eqNullSafe(F.col("lang_"))).drop("lang_")  # a row for each language
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("d", d)
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("off"), F.count(F.lit(1)).alias("kinds")).withColumn("b", F.col("off") / F.col("total"))
        c2 = ctx.select(F.col("lang").alias("lang_"), F.col("ctx").alias("ctx_"), "total", "b", "kinds")
        j = t.join(c2, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("ctx") == F.col("ctx_"))).drop("lang_", "ctx_")
        own = (F.col("c") - F.col("d")) / F.col("total")
        if n == 1:
            p = j.select("lang", "g", (own + F.col("b") / (F.col("kinds") + 1)).alias("v"))
            weights.append(c2.select(F.col("lang_").alias("lang"), F.lit("p").alias("kind"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), (1 / (F.col("kinds") + 1)).alias("v")))
        else:
            low = lower.select(F.col("lang").alias("lang_"), F.col("g").alias("g_"), F.col("v").alias("low"))
            p = j.join(low, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("g").bitwiseAND((1 << 16 * (n - 1)) - 1) == F.col("g_"))).select("lang", "g", (own + F.col("b") * F.col("low")).alias("v"))
        weights.append(c2.select(F.col("lang_").alias("lang"), F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), F.col("ctx_").alias("g"), F.col("b").alias("v")))
        lower = keep(p, f"p{n}", small=True)
        parts.append(lower.select("lang", F.lit("p").alias("kind"), F.lit(n).alias("n"), "g", "v"))
    return reduce(DataFrame.union, [*parts, keep(reduce(DataFrame.union, weights), "weights", small=True)])


#: Multipliers of the shard's two symbols; products stay far under 63 bits.
_LAST, _BEFORE = 2654435, 40503


def _shard(last: np.ndarray | F.Column, before: np.ndarray | F.Column, n: int) -> np.ndarray | F.Column:
    """The shard, of n, of n-grams whose context ends in two symbols; those that end in one are in about the root of n shards."""
    wide = math.isqrt(n)
    return (last * _LAST + before * _BEFORE % wide) % n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of rows by the number of their first one, which is the last column of batches: the same ones each time a table is read."""
    for batch in batches:
        _, off = flat(batch.columns[-2])
        for i, j in slices(off, BLOCK):
            yield batch.columns[-1][i].as_py(), pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:-1]], names=batch.schema.names[:-1])


def _asks(rows: pa.RecordBatch) -> dict[str | None, np.ndarray]:
    """The distinct n-grams of each language in order."""
    out: dict[str | None, list[np.ndarray]] = {}
    for names, _, key, _ in _by_lang(rows):
        distinct = counted(key)[0]
        for name in dict.fromkeys(names):
            out.setdefault(name, []).append(distinct)
    return {name: v[0] if len(v) == 1 else counted(np.concatenate(v))[0] for name, v in out.items()}


def _dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ascending ORDER-grams by shard, the shards that have any, and where each begins (and the end)."""
    shard = _shard((keys >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), (keys >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64), n)
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    return order, own, np.append(first, len(keys))


def _sharded(m: DataFrame, n: int) -> DataFrame:
    """of (shard), lang, at (n of 'p', -1 - n of 'b'), g, v of the tables of contexts and of n-grams from two symbols on."""
    symbol = lambda k: F.shiftrightunsigned("g", 16 * k).bitwiseAND(0xFFFF)
    p = F.col("kind") == "p"
    last, before = F.when(p, symbol(1)).otherwise(symbol(0)), F.when(p, symbol(2)).otherwise(symbol(1))
    wide = math.isqrt(n)
    one = (p & (F.col("n") == 2)) | (~p & (F.col("n") == 1))  # nothing but the last symbol is known: all shards that it can be in
    of = F.explode(F.when(one, F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: ((last * _LAST + i) % n).cast("int"))).otherwise(F.array(_shard(last, before, n).cast("int"))))
    rows = m.where((p & (F.col("n") >= 2)) | (~p & (F.col("n") >= 1)))
    return rows.select(of.alias("of"), "lang", F.when(p, F.col("n")).otherwise(-1 - F.col("n")).cast("byte").alias("at"), "g", F.col("v").cast("float").alias("v"))


Table = tuple[np.ndarray, np.ndarray]


def _tables(got: pa.Table) -> dict[str | None, dict[int, Table]]:
    """Sorted keys and values of each language's tables (columns lang, at, g, v)."""
    lang = got.column("lang").combine_chunks().dictionary_encode(null_encoding="encode")  # an index a row, no Python object
    code = lang.indices.to_numpy(zero_copy_only=False)
    at, g, v = got.column("at").to_numpy(), got.column("g").to_numpy().view(np.uint64), got.column("v").to_numpy()
    out: dict[str | None, dict[int, Table]] = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        own = np.flatnonzero(code == i)
        for k in np.unique(at[own]).tolist():
            on = own[at[own] == k]
            on = on[np.argsort(g[on])]
            out.setdefault(name, {})[k] = g[on], v[on]
    return out


def _find(t: Table | None, keys: np.ndarray) -> Table:
    if t is None or not len(t[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.searchsorted(t[0], keys)
    at[at == len(t[0])] = 0
    return t[0][at] == keys, t[1][at]


def probabilities(tables: dict[int, Table], key: np.ndarray) -> np.ndarray:
    """The interpolated probability of each ORDER-gram: that of the longest end that was seen, times the weights of the longer contexts."""
    p, left, weight = np.zeros(len(key)), np.arange(len(key)), np.ones(len(key))
    for n in range(ORDER, 0, -1):
        k = key[left] & np.uint64((1 << 16 * n) - 1)
        hit, v = _find(tables.get(n), k)
        p[left[hit]] = weight[left[hit]] * v[hit]
        left, k = left[~hit], k[~hit]
        if not len(left):
            return p
        seen, b = _find(tables.get(-n), k >> np.uint64(16))
        weight[left[seen]] *= b[seen]
    p[left] = weight[left] * tables[0][1][0]
    return p


def scores(docs: DataFrame, m: DataFrame) -> DataFrame:
    """key, n_tokens (symbols and the end), and by each model that is named between key and text its logprob (log10; null without a model).

    docs: key, one or more columns of languages, text; the columns of logprobs are called logprob_ and the language's column.
    """
    langs = docs.columns[1:-1]
    read = docs.withColumn("block", F.monotonically_increasing_id())
    n = shards(docs.sparkSession, docs)
    single = m.where("(kind = 'p' AND n <= 1) OR (kind = 'b' AND n = 0)").select("lang", F.when(F.col("kind") == "p", F.col("n")).otherwise(-1).cast("byte").alias("at"), "g", F.col("v").cast("float").alias("v"))
    sent = docs.sparkSession.sparkContext.broadcast(_tables(single.toArrow()))  # a row for each symbol

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            to: dict[int, list[tuple[str | None, bytes]]] = {}
            for name, keys in _asks(rows).items():
                order, own, b = _dealt(keys, n)
                for i, s in enumerate(own.tolist()):
                    to.setdefault(s, []).append((name, pack(keys[order[b[i] : b[i + 1]]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(to), pa.int32()), pa.array([block] * len(to), pa.int64()), pa.array([[x for x, _ in v] for v in to.values()], pa.list_(pa.string())), pa.array([[x for _, x in v] for v in to.values()], pa.list_(pa.binary()))],
                names=["shard", "block", "langs", "grams"],
            )

    def tell(group: pa.Table, own: pa.Table) -> pa.Table:
        """The probabilities of the blocks' n-grams in the order in which they asked; null for a language without a model."""
        tables = _tables(own)
        by: dict[str | None, list[tuple[int, int, np.ndarray]]] = {}
        names, packed = group.column("langs").to_pylist(), group.column("grams").to_pylist()
        for r, (row, raw) in enumerate(zip(names, packed, strict=True)):
            for i, name in enumerate(row):
                by.setdefault(name, []).append((r, i, unpack(raw[i])))
        del packed
        out: list[list[bytes | None]] = [[None] * len(row) for row in names]
        for name, asked in by.items():
            if name in sent.value:
                every, inverse = np.unique(np.concatenate([a for _, _, a in asked]), return_inverse=True)
                value = np.log10(probabilities(tables.get(name, {}) | sent.value[name], every)).astype("<f4")[inverse]
                end = 0
                for r, i, a in asked:
                    out[r][i], end = value[end : end + len(a)].tobytes(), end + len(a)
        return pa.Table.from_arrays([group.column("shard"), group.column("block"), group.column("langs"), pa.array(out, pa.list_(pa.binary()))], names=["shard", "block", "langs", "values"])

    asked = read.mapInArrow(tidy(ask), "shard int, block long, langs array<string>, grams array<binary>")
    values = asked.groupBy("shard").cogroup(_sharded(m, n).groupBy("of")).applyInArrow(tidy_pair(tell), "shard int, block long, langs array<string>, values array<binary>")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as w:
                w.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    schema = docs.select(docs.columns[0]).schema.add("n_tokens", "long")
    for name in langs:
        schema = schema.add(f"logprob_{name}", "double")

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        got: dict[str | None, list] = {}
        told = told.sort_by("shard")
        for names, packed in zip(told.column("langs").to_pylist(), told.column("values").to_pylist(), strict=True):
            for name, raw in zip(names, packed, strict=True):
                got.setdefault(name, []).append(raw)
        out = []
        for payload in texts.column("payload"):
            for rows in pa.ipc.open_stream(payload.as_buffer()).read_all().to_batches():
                asks = _asks(rows)
                tables: dict[str | None, np.ndarray | None] = {}
                for name, keys in asks.items():
                    told_ = got.get(name, [] if not len(keys) else None)
                    size = -1 if told_ is None else len(keys) if None in told_ else sum(map(len, told_)) // 4
                    if size != len(keys):
                        raise ValueError("a table gave other rows when it was read again")
                    tables[name] = None if None in told_ else np.empty(len(keys))
                    if tables[name] is not None:
                        tables[name][_dealt(keys, n)[0]] = np.frombuffer(b"".join(told_), "<f4")
                n_tokens, logprob = np.zeros(rows.num_rows, np.int64), np.full((len(langs), rows.num_rows), np.nan)
                for names, own, key, n_ in _by_lang(rows):  # made again, as all of a block's n-grams are some ten times its text
                    n_tokens[own] = n_
                    end = np.cumsum(n_)
                    for i, name in enumerate(names):
                        if name in names[:i]:
                            logprob[i, own] = logprob[names.index(name), own]
                        elif len(key) and tables[name] is not None:
                            total = np.concatenate([[0], np.cumsum(tables[name][np.searchsorted(asks[name], key)])])
                            logprob[i, own] = total[end] - total[end - n_]
                logprob[:, n_tokens == 0] = 0
                out.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_tokens), *(pa.array(p, pa.float64(), mask=np.isnan(p)) for p in logprob)], names=schema.names))
        return pa.Table.from_batches(out)

    texts = read.mapInArrow(tidy(send), "block long, payload binary")
    return texts.groupBy("block").cogroup(values.select(F.col("block").alias("of"), "shard", "langs", "values").groupBy("of")).applyInArrow(tidy_pair(score), schema)


def limits(steps: DataFrame) -> tuple[DataFrame, int | None]:
    """lang and the threshold's step of each language of steps (lang, step, c: trusted documents), and the step over all languages."""
    up = Window.partitionBy("lang").orderBy("step")
    steps = steps.withColumn("below", F.sum("c").over(up)).withColumn("all", F.sum("c").over(Window.partitionBy("lang")))
    reached = lambda share: F.min(F.when(F.col("below") >= share * F.col("all"), F.col("step")))
    own = steps.groupBy("lang").agg(reached(QUANTILE).alias("own"), reached(0.5).alias("middle"), F.max("all").alias("all"))
    middle = own.select(F.col("lang").alias("lang_"), "middle")
    away = steps.join(bounded_broadcast(middle, 1 << 14), F.col("lang").eqNullSafe(F.col("lang_")))
    over = away.agg(F.percentile(F.col("step") - F.col("middle"), QUANTILE, F.col("c")).alias("away"), F.percentile("step", QUANTILE, F.col("c")).alias("step")).first()
    if over.step is None:
        return own.select("lang", F.col("own").alias("step")), None
    # with fewer documents the quantile is the largest one's
    few = F.col("all") < 1 / (1 - QUANTILE)
    return own.select("lang", F.when(few, F.col("middle") + int(over.away)).otherwise(F.col("own")).alias("step")), int(over.step)


def _judged(base: DataFrame) -> DataFrame:
    """key, lang, n_tokens, logprob, perplexity, threshold, keep for each row of base (key, lang, text, trusted)."""
    # a language's model without part i goes by the name of "i:" and the language, that of all parts by FOLDS
    tag = lambda i: F.concat(i.cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))
    bare = F.when(F.length("lang") > 2, F.substring("lang", 4, 1 << 30)).alias("lang")
    own = base.where("trusted").withColumn("fold", F.pmod(F.xxhash64("key", "text"), F.lit(FOLDS)).cast("int"))
    each = counts(own.select("key", tag(F.col("fold")).alias("lang"), "text")).select(F.substring("lang", 1, 1).cast("int").alias("fold"), bare, "g", "c")
    parts = F.explode(F.filter(F.array(*map(F.lit, range(FOLDS + 1))), lambda i: i != F.col("fold")))
    every = each.select("lang", "g", "c", parts.alias("without")).groupBy(tag(F.col("without")).alias("lang"), "g").agg(F.sum("c").alias("c"))
    with scratch(base.sparkSession) as kept:  # the counts go before texts are scored
        m = model_of(staged(every, "grams", small=True), kept)
    # each row by the model of all parts, and a trusted one aside by the model without its part
    models = base.select(F.struct("key", "lang", "trusted").alias("key"), tag(F.lit(FOLDS)).alias("all"), F.when(F.col("trusted"), tag(F.pmod(F.xxhash64("key", "text"), F.lit(FOLDS)).cast("int"))).otherwise(tag(F.lit(FOLDS))).alias("part"), "text")
    perplexity = lambda p: F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.pow(F.lit(10.0), -F.col(p) / F.col("n_tokens")))
    got = scores(models, m).select("key.*", "n_tokens", F.col("logprob_all").alias("logprob"), perplexity("logprob_all").alias("perplexity"), perplexity("logprob_part").alias("aside"))
    got = staged(got, "scores", small=True)
    # quantiles by counts of small steps, which add up over tasks in any order
    steps = got.where("trusted AND n_tokens > 0 AND aside IS NOT NULL").groupBy("lang", F.floor(F.log10("aside") / STEP).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("c"))
    limit, pooled = limits(staged(steps, "steps"))
    at = lambda step: F.pow(F.lit(10.0), (step + 1) * STEP) * ROOM
    limit = limit.select(F.col("lang").alias("lang_"), at(F.col("step")).alias("threshold"))
    out = got.drop("aside", "trusted").join(bounded_broadcast(staged(limit, "thresholds"), 1 << 14), F.col("lang").eqNullSafe(F.col("lang_")), "left").drop("lang_")
    out = out.withColumn("threshold", F.coalesce("threshold", F.when((F.col("n_tokens") > 0) & F.col("logprob").isNotNull(), at(F.lit(pooled).cast("long")))))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def _marked(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str, *more: F.Column) -> DataFrame:
    trusted = labels.where("quality = 1").select(F.col(key).alias("key")).distinct().withColumn("mark", F.lit(True))
    base = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), *more)
    return base.join(bounded_broadcast(trusted, LABEL_ROWS), "key", "left").withColumn("trusted", F.coalesce("mark", F.lit(False))).drop("mark")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, n_tokens, logprob, perplexity, threshold, keep for each row of docs. labels: key and quality (1: trusted)."""
    with scratch(docs.sparkSession) as kept:
        return kept(_judged(_marked(docs, labels, key, text, lang)).withColumnRenamed("key", key), "judged")


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without those that the classifier rejects: rows that share a key, or have none, go by their own text and language."""
    with scratch(docs.sparkSession) as kept:
        base = _marked(docs, labels, key, text, lang)
        got = _judged(base.withColumn("key", F.struct("key", F.xxhash64("text", "lang").alias("digest"))))
        bad = kept(got.where("NOT keep").select("key.key", "key.digest").distinct(), "rejected")
    return without(docs, bad, docs[key], F.xxhash64(docs[text], docs[lang].cast("string")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
