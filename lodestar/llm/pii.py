"""Personal data by patterns and a skip-chain conditional random field.

Base spans are found by four patterns. The field then labels all other tokens that
hold a digit, an at sign or the local part of an address of the text: neighbours
share chain potentials, and mentions of one text that are the same or similar
share skip potentials, so a form that the patterns miss takes the label of its
repetition. Mentions are runs of tokens; they are alike by their digits whatever
parts them, by their digits without the country's, by their four numbers, or by
the part before an at sign, however it is written. Each token of a mention is
linked to the next alike mention and to the first alike base span of each kind, so
a label reaches any distance and a token that is repeated often stays cheap. Base
tokens are fixed; the others are labelled by loopy message passing, and spans are
added where a label is likely enough, also in texts without a base span (a card
behind another number, which the patterns take for one).

The field's weights are fitted by pseudo-likelihood on at most SAMPLE texts, whose
base spans are the labels, and on the same texts with some of these spans repeated
in another form (labelled alike), numbers of the same form that nothing in the text
is like (no label), and invented numbers side by side; of a text at most NODES
tokens are taken.

Edge cases: null and empty texts have no spans; a text without digits and at
signs is not looked at further; runs of digits of any length are judged; repeated
rows get equal spans; an empty table, or one without evidence, leaves weights of 0
that add nothing. Extra columns pass through masked(); null and repeated keys keep
their rows.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: Most texts that the field is fitted on, and tokens of each; least rounds of message passing, the change of messages that ends it, and the least probability of an added label.
SAMPLE, NODES, ROUNDS, SETTLED, SURE = 2000, 400, 12, 1e-3, 0.7
#: Most tokens and digits of a mention.
TOKENS, DIGITS = 6, 19

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _four(numbers: list[str]) -> str | None:
    """Four numbers of at most 255 as one name, or None."""
    short = [n.lstrip("0") or "0" for n in numbers]
    return ".".join(short) if len(short) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in short) else None


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each kind's leftmost matches, in order of start and then of KINDS."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # the leftmost start before an at sign is where its run of local characters begins
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a longer dotted number leaves its rest to the next match
            if _four(m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


# -- the field

_FEATURES = 27
_L = len(KINDS) + 1
_NUMBER = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[(\[{]at[)\]}]")
_BARE = re.compile(r"(?=[a-z0-9%+-]*[._0-9])(?=.*[a-z])[a-z0-9._%+-]{4,}")
_LETTER = re.compile(r"[^\W\d_]")

Node = tuple[int, int, str]


def nodes(text: str, locals_: frozenset[str] = frozenset()) -> list[Node]:
    """Start, end and text of each token with a digit or an at sign, or that is one of locals_, without marks at its ends."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if "@" in t or _DIGIT.search(t) or (locals_ and t.strip("*#$%&!?|,;:.\"'<>[]{}()=/\\").lower() in locals_):
            core = t.strip("*#$%&!?|,;:.\"'<>[]{}=/\\")
            core = core[:-1] if core.endswith(")") and "(" not in core else core[1:] if core.startswith("(") and ")" not in core else core
            if core:
                s = m.start() + t.index(core)
                out.append((s, s + len(core), core))
    return out


def features(text: str, node: Node) -> np.ndarray:
    s, e, t = node
    number = "".join(_NUMBER.findall(t))
    digits = len(number)
    before, after = text[max(0, s - 2) : s].strip()[-1:], text[e : e + 2].strip()[:1]
    groups = len(_NUMBER.findall(t))
    f = np.zeros(_FEATURES)
    f[0] = 1
    f[1], f[2] = "@" in t, "." in t
    f[3], f[4] = _four(_NUMBER.findall(t)) is not None, t.startswith("+") or before == "+"
    f[5], f[6] = "-" in t, "(" in t or ")" in t
    f[7 + min(6, digits // 3)] = 1
    f[14] = digits == len(t)
    f[15] = _LETTER.search(t) is not None
    f[16], f[17] = before.isdigit() or before == ")", after.isdigit() or after in ("(", "-")
    f[18] = 14 <= digits <= 19 and luhn(number)
    f[19] = 14 <= digits <= 19 and not f[18]
    f[20] = "@" in t and "." in t.partition("@")[2]
    f[21] = 10 <= digits <= 15
    f[22], f[23] = groups == 3, groups > 4
    f[24] = before in ("=", '"', "'")
    f[25] = digits == 0
    return f


def _names(kind_text: str) -> set[str]:
    """What a run of tokens without letters is known by: its digits, those without the country's, its four numbers."""
    numbers = _NUMBER.findall(kind_text)
    digits = "".join(numbers)
    out = set()
    if 7 <= len(digits) <= DIGITS:
        out.add("d" + digits)
        if len(digits) > 10 and "+" in kind_text:
            out.add("d" + digits[-10:])
        elif len(digits) == 11 and digits[0] == "1":
            out.add("d" + digits[1:])
    if four := _four(numbers):
        out.add("q" + four)
    return out


def mentions(text: str, own: list[Node]) -> list[tuple[str, int, int]]:
    """Name, first and last token of each run of tokens that may be alike to others."""
    out = []
    plain = [not _LETTER.search(n[2]) and "@" not in n[2] for n in own]
    for i, (s, e, t) in enumerate(own):
        if not plain[i]:
            local = _AT.split(t.lower(), maxsplit=1)
            if len(local[0]) >= 3 and (len(local) == 2 or _BARE.fullmatch(local[0])):
                out.append(("l" + local[0], i, i))
            continue
        digits = 0
        for j in range(i, min(i + TOKENS, len(own))):
            if not plain[j] or (j > i and own[j][0] - own[j - 1][1] > 3):
                break
            digits += sum(map(len, _NUMBER.findall(own[j][2])))
            if digits > DIGITS:
                break
            out += [(k, i, j) for k in _names(text[max(0, s - 1) : own[j][1]] if text[max(0, s - 1) : s] == "+" else text[s : own[j][1]])]
    return out


def international(text: str, own: list[Node]) -> Iterator[tuple[int, int]]:
    """First and last token of each run behind a plus sign that comes to 10 to 15 digits before it meets anything else."""
    for i, (s, _, t) in enumerate(own):
        if t.startswith("+") or text[max(0, s - 1) : s] == "+":
            digits, j = 0, i
            while j < min(i + TOKENS, len(own)):
                numbers = _NUMBER.findall(own[j][2])
                if _LETTER.search(own[j][2]) or (j > i and (own[j][0] - own[j - 1][1] > 3 or "+" in own[j][2] or _four(numbers))):
                    break
                digits += sum(map(len, numbers))
                if digits >= 10:
                    if digits <= 15:
                        yield i, j
                    break
                j += 1


def _local_parts(text: str, spans: list[tuple[int, str, int]]) -> frozenset[str]:
    got = (text[s:e].split("@", 1)[0].lower() for s, k, e in spans if k == "email")
    return frozenset(x for x in got if _BARE.fullmatch(x))


class Graph:
    """Tokens of one text with their unary features, chain and skip links."""

    def __init__(self, text: str, spans: list[tuple[int, str, int]]):
        self.nodes = nodes(text, _local_parts(text, spans))
        self.text = text
        self.x = np.array([features(text, n) for n in self.nodes]).reshape(-1, _FEATURES)
        for i, j in international(text, self.nodes):
            self.x[i : j + 1, 26] = 1
        chain = [(i, i + 1) for i in range(len(self.nodes) - 1) if self.nodes[i + 1][0] - self.nodes[i][1] <= 3]
        at: dict[str, set[tuple[int, int]]] = {}
        for name, i, j in mentions(text, self.nodes):
            at.setdefault(name, set()).add((i, j))
        ends = [n[1] for n in self.nodes]
        base: dict[str, dict[str, int]] = {}
        for s, kind, e in spans:
            i = j = bisect.bisect_right(ends, s)
            while j + 1 < len(self.nodes) and self.nodes[j + 1][0] < e:
                j += 1
            if i < len(self.nodes) and self.nodes[i][0] < e:
                for name in {"l" + text[s:e].split("@", 1)[0].lower()} if kind == "email" else _names(text[s:e]):
                    at.setdefault(name, set()).add((i, j))
                    base.setdefault(name, {}).setdefault(kind, i)
        skip = set()
        for name, where in at.items():
            if len(where) > 1:
                before = None
                for i, j in sorted(where):
                    hubs = {*base.get(name, {}).values(), *([] if before is None else [before])}
                    skip.update((min(h, k), max(h, k)) for h in hubs for k in range(i, j + 1) if not i <= h <= j)
                    before = i
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(skip), np.int64).reshape(-1, 2)

    def fixed(self, spans: list[tuple[int, str, int]]) -> np.ndarray:
        """The label that base spans give each token: 0 none, else kind + 1."""
        out = np.zeros(len(self.nodes), np.int64)
        starts, ends = np.array([n[0] for n in self.nodes], np.int64), np.array([n[1] for n in self.nodes], np.int64)
        for s, kind, e in spans:
            out[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e)] = KINDS.index(kind) + 1
        return out


Weights = tuple[np.ndarray, np.ndarray, np.ndarray]


def _softmax(v: np.ndarray) -> np.ndarray:
    v = np.exp(v - v.max(axis=-1, keepdims=True))
    return v / v.sum(axis=-1, keepdims=True)


def reformed(kind: str, span: str, draw: random.Random) -> str:
    """A base span in another form that the patterns needn't find."""
    if kind == "email":
        local, domain = span.split("@", 1)
        return draw.choice([f"{local} at {domain.replace('.', ' dot ')}", f"{local}(at){domain}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local}@{domain.split('.')[0]}", local])
    digits = "".join(_NUMBER.findall(span))
    if kind == "ip":
        return draw.choice([",", "-", "[.]", " . ", " ", ":"]).join(_NUMBER.findall(span))
    if kind == "card":
        return draw.choice([".", "/", "_", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    end = digits[-10:]
    form = draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}", "{}{}{}"])
    return draw.choice(["", "", "1 ", "1-"]) + form.format(end[:3], end[3:6], end[6:])


def crowd(draw: random.Random) -> list[tuple[str, str | None]]:
    """Numbers that stand side by side, where the patterns may take them for one, and their kinds (None: another number)."""
    number = lambda n: "".join(str(draw.randrange(10)) for _ in range(n))
    out = []
    for kind in draw.choices(["card", None, "ip", "phone"], k=draw.randrange(2, 4)):
        if kind == "ip":
            part = ".".join(str(draw.randrange(256)) for _ in range(4))
        elif kind == "phone":
            part = f"+{draw.randrange(1, 50)} ({number(3)}) {number(3)}-{number(4)}"
        else:
            part = next(x for x in iter(lambda: number(16), None) if luhn(x) == (kind == "card"))
        out.append((part, kind))
    return out


def planted(text: str, spans: list[tuple[int, str, int]], draw: random.Random) -> tuple[str, list[tuple[int, str, int]]]:
    """text and behind it some of its spans in another form, by chance beside the same form of other digits, and a crowd of numbers; and the spans of what is personal data there."""
    between = [m[0] for m in _TOKEN.finditer(text[:2000]) if m[0].isalpha()] or ["and"]
    out, added = text, []
    for s, kind, e in draw.sample(spans, min(2, len(spans))):
        form = reformed(kind, text[s:e], draw)
        other = "".join(str(draw.randrange(10)) if c.isdigit() else draw.choice("aeionrst") if kind == "email" and c.isalpha() else c for c in reformed(kind, text[s:e], draw))
        parts = [(form, True), *([(other, False)] if draw.random() < 0.6 else [])]
        draw.shuffle(parts)
        for part, real in parts:
            out += " " + " ".join(draw.choice(between) for _ in range(draw.randrange(1, 4))) + " "
            if real:
                # of an address that is spelt out, the local part is what is labelled
                added.append((len(out), kind, len(out) + len(part.split(" ")[0] if kind == "email" else part)))
            out += part
    out += " " + draw.choice(between)
    for part, kind in crowd(draw):
        out += " " + part
        if kind:
            added.append((len(out) - len(part), kind, len(out)))
    return out + " " + draw.choice(between), added


Example = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def example(text: str, added: list[tuple[int, str, int]] = ()) -> Example | None:
    """Features, labels and how many chain and skip neighbours have each label, of the tokens of a text."""
    spans = base_spans(text)
    g = Graph(text, spans)
    if not len(g.nodes):
        return None
    y = g.fixed(spans)
    y = np.where(y > 0, y, g.fixed(list(added)))
    near = [np.zeros((len(y), _L)), np.zeros((len(y), _L))]
    for links, count in ((g.chain, near[0]), (g.skip, near[1])):
        np.add.at(count, (links[:, 0], y[links[:, 1]]), 1)
        np.add.at(count, (links[:, 1], y[links[:, 0]]), 1)
    if len(y) > NODES:
        on = np.random.default_rng(len(y)).choice(len(y), NODES, replace=False)
        return g.x[on], y[on], near[0][on], near[1][on]
    return g.x, y, near[0], near[1]


def examples(text: str | None) -> list[Example]:
    """The text as it is, and, if it has base spans, three times with other forms planted."""
    if not text or ("@" not in text and not _DIGIT.search(text)):
        return []
    spans = base_spans(text)
    draw = random.Random(len(text))
    return [x for x in [example(text), *(example(*planted(text, spans, draw)) for _ in range(3 if spans else 0))] if x]


def fit(texts: list[str | None]) -> Weights:
    return solve([x for t in texts for x in examples(t)])


def solve(got: list[Example], steps: int = 500, rate: float = 0.1, ridge: float = 2e-4) -> Weights:
    """Pseudo-likelihood of each token's label given its features and its neighbours' labels, by Adam steps over all tokens."""
    shapes = [(_FEATURES, _L), (_L, _L), (_L, _L)]
    if not got:
        return tuple(np.zeros(x) for x in shapes)
    x, y, c, s = (np.concatenate([g[i] for g in got]) for i in range(4))
    hot = np.eye(_L)[y]
    inputs = np.concatenate([x, c, s], axis=1)
    w = np.zeros((inputs.shape[1], _L))
    m, v = np.zeros_like(w), np.zeros_like(w)
    links = [slice(_FEATURES, _FEATURES + _L), slice(_FEATURES + _L, _FEATURES + 2 * _L)]
    for t in range(1, steps + 1):
        d = inputs.T @ (_softmax(inputs @ w) - hot) / len(y) + ridge * w
        for k in links:
            d[k] = (d[k] + d[k].T) / 2  # a link is the same from both ends
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        for k in links:
            w[k] = (w[k] + w[k].T) / 2
    return w[:_FEATURES], w[links[0]], w[links[1]]


def infer(g: Graph, label: np.ndarray, weights: Weights, settled: float = SETTLED) -> np.ndarray:
    """Probabilities of each token's labels by loopy message passing until it settles; labels over 0 are fixed."""
    unary, chain, skip = weights
    u = g.x @ unary
    u = u - u.max(axis=1, keepdims=True)
    u[label > 0] = -30
    u[np.flatnonzero(label > 0), label[label > 0]] = 0
    links = np.concatenate([g.chain, g.skip])
    if not len(links):
        return _softmax(u)
    src = np.concatenate([links[:, 0], links[:, 1]])
    dst = np.concatenate([links[:, 1], links[:, 0]])
    m = len(links)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    pair = np.where((np.arange(2 * m) % m < len(g.chain))[:, None, None], chain, skip)
    msg = np.zeros((2 * m, _L))
    for t in range(8 * ROUNDS + 2 * len(u)):  # a path is no longer than the tokens; messages that swing end then
        before = msg
        total = u.copy()
        np.add.at(total, dst, msg)
        into = total[src] - msg[back]
        new = into[:, :, None] + pair
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
        msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
        if t >= ROUNDS and np.abs(msg - before).max() < settled:
            break
    total = u.copy()
    np.add.at(total, dst, msg)
    return _softmax(total)


def _joint(g: Graph, guess: np.ndarray, add: np.ndarray) -> list[tuple[int, str, int]]:
    """Spans of added tokens: neighbours of one kind are one span as far as it has that kind's digits."""
    most = {"phone": 15, "card": 19, "ip": 12, "email": 0}
    out: list[tuple[int, str, int]] = []
    last = -2
    for i in add.tolist():
        s, e, _ = g.nodes[i]
        kind = KINDS[guess[i] - 1]
        if out and last == i - 1 and out[-1][1] == kind and s - out[-1][2] <= 3:
            numbers = _NUMBER.findall(g.text[out[-1][0] : e])
            if sum(map(len, numbers)) <= most[kind] and (kind != "ip" or len(numbers) <= 4):
                out[-1] = (out[-1][0], kind, e)
                last = i
                continue
        out.append((s, kind, e))
        last = i
    return out


def all_spans(text: str, weights: Weights) -> tuple[list, list]:
    """Base spans, and all spans: base ones and those that the field adds beside them."""
    base = base_spans(text)
    g = Graph(text, base)
    label = g.fixed(base)
    if not len(label) or label.all():
        return base, base
    p = infer(g, label, weights)
    guess = p.argmax(axis=1)
    add = np.flatnonzero((label == 0) & (guess > 0) & (p.max(axis=1) >= SURE))
    return base, sorted(base + _joint(g, guess, add), key=lambda x: (x[0], KINDS.index(x[1])))


def found(docs: DataFrame, weights: Weights, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans (arrays of kind, start, end in code points) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            base, every = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                b, a = all_spans(t, w) if "@" in t or _DIGIT.search(t) else ([], [])
                base.append(rows(b))
                every.append(rows(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, struct), pa.array(every, struct)], names=[key, "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(key, text).mapInArrow(tidy(run), f"{key} {docs.schema[key].dataType.simpleString()}, base {kind}, spans {kind}")


def trained(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Weights:
    """Weights from at most `most` texts that hold an at sign or a long number, those of least digests.

    Executors make the examples of these texts; the driver gets their numbers alone.
    """
    likely = docs.where(F.col(text).rlike("@|[0-9]{6}|[0-9][.][0-9]"))
    row = F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("pii"))
    picked = likely.select(row.alias("row")).orderBy("row").limit(most).distinct()
    got = likely.select(row.alias("row"), F.col(text).alias("text")).join(F.broadcast(picked), "row", "left_semi")  # `most` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0), batch.column(1), strict=True):
                for i, e in enumerate(examples(t.as_py())):
                    flat_ = np.concatenate([e[0], e[1][:, None], e[2], e[3]], axis=1).astype("<f4")
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()]), pa.array([i], pa.int32()), pa.array([flat_.tobytes()], pa.binary())], names=["row", "i", "example"])

    rows = sorted({(r.row, r.i): bytes(r.example) for r in got.mapInArrow(tidy(run), "row long, i int, example binary").collect()}.items())
    flat_ = [np.frombuffer(raw, "<f4").reshape(-1, _FEATURES + 1 + 2 * _L).astype(np.float64) for _, raw in rows]
    cut = _FEATURES + 1
    return solve([(f[:, :_FEATURES], f[:, _FEATURES].astype(np.int64), f[:, cut : cut + _L], f[:, cut + _L :]) for f in flat_])


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of their text replaced by its kind in brackets; overlapping spans become one."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, key, text))
    free()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            out = []
            for t in batch.column(at):
                t = t.as_py()
                spans = all_spans(t, w)[1] if t and ("@" in t or _DIGIT.search(t)) else []
                if spans:
                    parts, end = [], 0
                    for s, k, e in spans:
                        if s >= end:
                            parts += [t[end:s], f"[{k.upper()}]"]
                        end = max(end, e)
                    t = "".join(parts) + t[end:]
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.types[at]))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = found(docs, trained(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return got.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
