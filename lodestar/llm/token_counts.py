"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In each
round every sequence applies its lowest-rank pair at all its places, all sequences
at once, until no pair of any sequence is in the vocabulary; the symbols that
survive are the tokens. The rule is one place at a time, the leftmost first: if a
place makes a new pair of a rank that isn't higher, its sequence applies the
leftmost place alone in that round. Rounds are thus no more than the ranks that
occur, but for such places. Only distinct pre-tokens are merged, and counts are
remembered by their characters; a hash only finds those that may be equal.

For a sentencepiece BPE model with byte fallback: white space is kept, each
space becomes U+2581 and one is put in front; no piece holds U+2581 after
another character, so pre-tokens start where U+2581 follows another character.
A character outside the vocabulary counts as its UTF-8 bytes.

Edge cases: null and empty texts have 0 tokens; repeated rows are counted alike;
a text without spaces is one pre-token of any length; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, slices, table, word_hashes

OVER = 4096
#: Distinct pre-tokens whose counts a worker remembers, each of so many bytes at most.
REMEMBER, REMEMBER_BYTES = 1 << 18, 160
_SPACE = "▁"


class Merger:
    """Merge tables of one sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece holds U+2581 inside: pre-tokens can't be split there")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        self.n = sp.get_piece_size()
        self.char = {ord(p): i for p, i in pieces.items() if len(p) == 1}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = pieces.get(p[:k]), pieces.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (order[sp.get_score(i)], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [1 << 30], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int64)
        self._table()
        self.bmp = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            self.bmp[c] = i

    def _table(self) -> None:
        """Open addressing of the pairs: a slot is tried after the other until one is free, at most self.tries."""
        self.bits = max(4, int(len(self.keys) * 6).bit_length())
        self.slots, self.at = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, self.tries = np.arange(len(self.keys)), 0
        while len(left):
            slot = (self._slot(self.keys[left]) + self.tries) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.slots[slot] < 0)
            took, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.slots[took], self.at[took] = self.keys[left[own]], left[own]
            left = np.delete(left, own)
            self.tries += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in the tables, or of their last entry."""
        out = np.full(len(a), len(self.keys), np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[left] * self.n + b[left]
        slot = self._slot(key)
        for _ in range(self.tries):
            got = self.slots[slot]
            hit = got == key
            out[left[hit]] = self.at[slot[hit]]
            on = np.flatnonzero(~hit & (got >= 0))
            if not len(on):
                break
            left, key, slot = left[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, chars: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points; off has n + 1 entries, no sequence is empty."""
        ids = self.bmp[chars].astype(np.int64)
        bytes_ = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        out = np.add.reduceat(np.where(ids < 0, bytes_, 0), off[:-1])
        syms, sizes = ids, np.diff(off)
        seq = np.repeat(np.arange(len(sizes)), sizes)
        last = off[1:] - 1
        none = len(self.keys)
        if len(syms):
            pair = self.look(syms, np.append(syms[1:], -1))
            pair[last] = none
        while len(syms):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            rank = self.rank[pair]
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(syms)))
            idle = low == 1 << 30
            if idle.any():  # these sequences have ended
                out[seq[first[idle]]] += np.add.reduceat((syms >= 0).astype(np.int64), first)[idle]
                on = np.repeat(~idle, count)
                syms, seq, pair, rank = syms[on], seq[on], pair[on], rank[on]
                if not len(syms):
                    break
                low, count = low[~idle], count[~idle]
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
            at = self._places(syms, seq, pair, rank, np.repeat(low, count))
            syms[at] = self.made[pair[at]]
            gone = np.ones(len(syms), bool)
            gone[at + 1] = False
            shift = np.cumsum(~gone)
            at = at - shift[at]
            syms, seq, pair = syms[gone], seq[gone], pair[gone]
            # only the pairs beside what was merged are new
            near = np.concatenate([at, at[at > 0] - 1])
            nxt = np.minimum(near + 1, len(syms) - 1)
            same = (near + 1 < len(syms)) & (seq[nxt] == seq[near])
            pair[near] = np.where(same, self.look(syms[near], syms[nxt]), none)
        return out

    def _places(self, syms: np.ndarray, seq: np.ndarray, pair: np.ndarray, rank: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where pairs of the lowest rank are merged in this round: places that don't overlap, the left ones first."""
        hit = np.flatnonzero(rank == low)
        head = np.concatenate([[True], np.diff(hit) > 1])
        run = np.flatnonzero(head)
        at = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
        own = seq[at]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        if first.all():
            return at
        made = self.made[pair[at]]
        # the pairs that each place makes when it is merged after those on its left
        left = np.maximum(at - 1, 0)
        before = syms[left]
        joined = np.concatenate([[False], at[1:] - at[:-1] == 2]) & ~first
        before[joined] = made[np.flatnonzero(joined) - 1]
        inner = (at > 0) & (seq[left] == own)
        right = np.minimum(at + 2, len(syms) - 1)
        outer = (at + 2 < len(syms)) & (seq[right] == own)
        worse = np.zeros(len(at), bool)
        for ok, a, b in ((inner, before, made), (outer, made, syms[right])):
            worse |= ok & (self.rank[self.look(a, b)] <= low[at])
        bad = np.zeros(int(seq[-1]) + 1, bool)
        bad[own[worse]] = True
        return at[first | ~bad[own]]


_mergers: dict[str, Merger] = {}
_known: dict[str, dict[bytes, int]] = {}


def merger(model: str) -> Merger:
    """A model by its file, or by its name among the public tokenizers of each machine."""
    if model not in _mergers:
        import os

        import public_tokenizers

        _mergers[model] = Merger(model if os.path.exists(model) else public_tokenizers.path(model))
    return _mergers[model]


def count_batch(m: Merger, data: np.ndarray, off: np.ndarray, memory: dict[bytes, int]) -> np.ndarray:
    """Tokens of each UTF-8 text. memory: counts of pre-tokens by their characters, which grows."""
    n = len(off) - 1
    filled = np.flatnonzero(np.diff(off) > 0)
    total = np.zeros(n, np.int64)
    if not len(filled):
        return total
    cp = np.frombuffer(data[off[0] : off[-1]].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = (data[off[0] : off[-1]] & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[off - off[0]]
    # one U+2581 goes before each text that isn't empty
    starts = at[filled]
    chars = np.insert(np.where(cp == 32, np.uint32(0x2581), cp), starts, np.uint32(0x2581))
    begin = starts + np.arange(len(filled))
    us = chars == 0x2581
    cut = us.copy()
    cut[1:] &= ~us[:-1]
    cut[begin] = True
    tok = np.flatnonzero(cut)
    end = np.append(tok[1:], len(chars))
    raw = chars.astype("<u4").view(np.uint8)
    h = word_hashes(raw, tok * 4, end * 4)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    # a pre-token that isn't that of its hash, character by character, stands for itself
    like = first[inverse]
    size = end - tok
    same = size == size[like]
    own = np.flatnonzero(same & (like != np.arange(len(tok))))
    o = np.concatenate([[0], np.cumsum(size[own])])
    step = np.arange(o[-1]) - np.repeat(o[:-1], size[own])
    differs = chars[step + np.repeat(tok[own], size[own])] != chars[step + np.repeat(tok[like[own]], size[own])]
    if differs.any():
        same[own[np.add.reduceat(differs, o[:-1]) > 0]] = False
    odd = np.flatnonzero(~same)
    inverse[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    text = raw.tobytes()
    names = [text[4 * s : 4 * e] for s, e in zip(tok[first].tolist(), end[first].tolist(), strict=True)]
    each = np.array([memory.get(x, -1) for x in names], np.int64)
    if (new := np.flatnonzero(each < 0)).size:
        s, e = tok[first[new]], end[first[new]]
        sizes = e - s
        o = np.concatenate([[0], np.cumsum(sizes)])
        idx = np.arange(o[-1]) - np.repeat(o[:-1], sizes) + np.repeat(s, sizes)
        each[new] = m.counts(chars[idx], o)
        if len(memory) + len(new) > REMEMBER:
            memory.clear()
        memory.update((names[i], int(each[i])) for i in new.tolist() if len(names[i]) <= REMEMBER_BYTES)
    doc = np.searchsorted(begin, tok, "right") - 1
    total[filled] = np.bincount(doc, weights=each[inverse], minlength=len(filled)).astype(np.int64)
    return total


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", limit: int = OVER) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(model)
        for batch in batches:
            data, off = flat(batch.column(1))
            n = np.zeros(len(off) - 1, np.int64)
            for i, j in slices(off):
                n[i:j] = count_batch(m, data, off[i : j + 1], _known.setdefault(model, {}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
