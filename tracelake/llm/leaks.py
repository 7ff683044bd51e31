"""Passages of held-out items in a training corpus, found with word-level suffix arrays over shards of the corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import cut, ship, spread

_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|q|s|small|span|strong|sub|sup|tt|u)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_TARGET = re.compile(r"\]\([^()\s]*\)")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SIGN = re.compile(r"[^\w\s]+|_+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")


def words(text: str) -> list[str]:
    """Words without case, punctuation, spacing and markup; what has no letter or digit is no word."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    if "](" in text:
        text = _TARGET.sub(" ", text)
    return _SIGN.sub("", text.casefold()).split()


def item_bodies(items: list[tuple[int, str | None]], shared_by: int = 3) -> dict[int, list[list[str]]]:
    """Words of each text of each item without its opening sentences that stand in at least ``shared_by`` items."""
    heads: dict[str, set[int]] = {}
    split: list[tuple[int, list[str]]] = []
    for i, t in sorted({(i, t) for i, t in items if i is not None and t}):
        split.append((i, _SENTENCE.split(t)))
        for s in split[-1][1]:
            heads.setdefault(" ".join(words(s)), set()).add(i)
    out: dict[int, list[list[str]]] = {}
    for i, sentences in split:
        n = 0
        while n < len(sentences) and len(heads[" ".join(words(sentences[n]))]) >= shared_by:
            n += 1
        out.setdefault(i, []).append(words(" ".join(sentences[n:])))
    return out


@dataclass(frozen=True)
class Rule:
    """At least ``span`` successive words of the item, up to ``edits`` of them replaced or beside an extra word."""

    span: int = 20
    edits: int = 2

    @property
    def seed(self) -> int:
        """Words that one verbatim stretch of a passage has at least."""
        return -(-(self.span - self.edits) // (self.edits + 1))


def word_numbers(ws: list[str], known: dict[str, int]) -> list[int]:
    """Words as 64-bit hashes, the same everywhere; 0 is none. ``known`` keeps those of the words met so far."""
    out = []
    for w in ws:
        n = known.get(w)
        if n is None:
            n = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
        out.append(n)
    return out


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``flat``, texts with a 0 behind each; a suffix ends with its text.

    Prefix doubling: what the first h words leave tied is ordered by the ranks of the next h. A rank is the place of its
    group, so only groups that are still tied and go on take part in a round.
    """
    n = len(flat)
    order = np.argsort(flat, kind="stable")
    if not n:
        return order
    first = np.ones(n, bool)
    first[1:] = flat[order[1:]] != flat[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ends = np.flatnonzero(flat == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if len(ends) and ends[-1] == n - 1 else np.arange(n, 0, -1) - 1
    slots = np.arange(n)
    h = 1
    while True:
        # Tied slots: the neighbour on one side has the same rank, and the text goes on.
        r = rank[order[slots]]
        tied = np.zeros(len(slots), bool)
        same = (r[1:] == r[:-1]) & (slots[1:] == slots[:-1] + 1)
        tied[1:] |= same
        tied[:-1] |= same
        slots = slots[tied & (room[order[slots]] > h - 1)]
        if not len(slots):
            return order
        here = order[slots]
        r, onward = rank[here], rank[np.minimum(here + h, n - 1)]
        by = np.lexsort((onward, r))
        here, r, onward = here[by], r[by], onward[by]
        order[slots] = here
        new = np.ones(len(slots), bool)
        new[1:] = (r[1:] != r[:-1]) | (onward[1:] != onward[:-1])
        rank[here] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2


@dataclass
class Shard:
    """Suffix array over the documents of a shard, whatever will be looked up in it."""

    ids: list
    starts: np.ndarray
    flat: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, ids: list, numbers: list[list[int]]) -> Shard:
        starts = np.concatenate([[0], np.cumsum(np.fromiter((len(x) + 1 for x in numbers), np.int64, len(numbers)))])
        flat = np.zeros(starts[-1], np.uint64)
        for at, x in zip(starts.tolist(), numbers, strict=False):
            flat[at : at + len(x)] = x
        return cls(ids, starts, flat, suffix_array(flat))


class Items:
    """The items' words as numbers, a 0 behind each text."""

    def __init__(self, bodies: list[tuple[int, list[str]]]):
        known: dict[str, int] = {}
        flat, owner = [0], [-1]
        for i, body in bodies:
            flat += [*word_numbers(body, known), 0]
            owner += [i] * (len(body) + 1)
        self.flat, self.owner = np.array(flat, np.uint64), np.array(owner, np.int64)

    def longest_matches(self, shard: Shard, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, its longest match in words, first and last place of its matches of ``least`` words), by binary search.

        All suffixes are searched at once, word by word: within the places that agree so far, the next word is in order.
        """
        flat, order = shard.flat, shard.order
        at = np.flatnonzero(self.flat)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        out = [np.zeros(0, np.int64)] * 4
        rows: list[tuple[np.ndarray, ...]] = []
        kept_low = kept_high = np.zeros(0, np.int64)
        depth = 0
        while len(at):
            wanted = self.flat[at + depth]
            new_low, new_high = (_bound(flat, order, low, high, wanted, depth, right) for right in (False, True))
            go = (new_low < new_high) & (wanted != 0)
            if depth >= least:
                rows.append((at[~go], np.full((~go).sum(), depth, np.int64), kept_low[~go], kept_high[~go]))
                kept_low, kept_high = kept_low[go], kept_high[go]
            at, low, high = at[go], new_low[go], new_high[go]
            depth += 1
            if depth == least:
                kept_low, kept_high = low, high
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True)) if rows else tuple(out)

    def search(self, shard: Shard, rule: Rule) -> pd.DataFrame:
        """(doc_id, item_id, verbatim, longest, doc_word, item_word) over a shard: the longest verbatim match and passage of
        each document and item, and where the verbatim match begins in both, in words."""
        suffixes, _, low, high = self.longest_matches(shard, rule.seed)
        found = []
        ends = np.cumsum(high - low)
        begun = 0
        while begun < len(suffixes):  # places of a few suffixes at a time, or of a part of one
            last = max(int(np.searchsorted(ends, (ends[begun - 1] if begun else 0) + PAIRS, "right")), begun + 1)
            sizes = (high - low)[begun:last]
            for a in range(0, int(sizes.sum()), PAIRS):
                k = np.arange(a, min(a + PAIRS, int(sizes.sum())))
                which = np.searchsorted(np.cumsum(sizes), k, "right")
                offset = k - (np.cumsum(sizes) - sizes)[which]
                t, s = suffixes[begun:last][which], shard.order[low[begun:last][which] + offset]
                found.append(self._passages(shard, rule, t, s))
            begun = last
        columns = ["doc_id", "item_id", "verbatim", "longest", "doc_word", "item_word"]
        if not found:
            return pd.DataFrame([], columns=columns)
        pairs = pd.concat(found)
        pairs = pairs.sort_values(["verbatim", "doc_word", "item_word"], ascending=[False, True, True], kind="stable")
        best = pairs.groupby(["doc", "item_id"], sort=False).agg(verbatim=("verbatim", "max"), longest=("longest", "max"), doc_word=("doc_word", "first"), item_word=("item_word", "first")).reset_index()
        best = best[best.longest >= rule.span]
        return best.assign(doc_id=[shard.ids[d] for d in best.doc])[columns]

    def _passages(self, shard: Shard, rule: Rule, t: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        v, w = self.flat, shard.flat
        before = (self.flat[t - 1] != 0) & (s > 0)
        before[before] &= v[t[before] - 1] == w[s[before] - 1]  # inside a longer match, which has a place of its own
        t, s = t[~before], s[~before]
        right, left = _stretches(v, w, t, s, rule.edits, 1), _stretches(v, w, t - 1, s - 1, rule.edits, -1)
        longest = np.max([right[a] + left[b] for a in range(rule.edits + 1) for b in range(rule.edits + 1 - a)], axis=0) if len(t) else np.zeros(0, np.int64)
        doc = np.searchsorted(shard.starts, s, "right") - 1
        texts = np.flatnonzero(v == 0)
        return pd.DataFrame({"doc": doc, "item_id": self.owner[t], "verbatim": right[0], "longest": longest, "doc_word": s - shard.starts[doc], "item_word": t - texts[np.searchsorted(texts, t) - 1] - 1})


def _bound(flat: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, right: bool) -> np.ndarray:
    """The first place of each range whose word ``depth`` is not less (``right``: is greater) than the one wanted."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        word = flat[np.minimum(order[mid] + depth, len(flat) - 1)]
        on = word <= wanted[open_] if right else word < wanted[open_]
        low[open_[on]] = mid[on] + 1
        high[open_[~on]] = mid[~on]
        open_ = open_[low[open_] < high[open_]]
    return low


def _equal_run(v: np.ndarray, w: np.ndarray, j: np.ndarray, k: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``v[j]`` and ``w[k]`` on are equal; 0 stands for no word."""
    n = np.zeros(len(j), np.int64)
    at = np.arange(len(j))
    while len(at):
        a, b = j[at] + step * n[at], k[at] + step * n[at]
        at = at[(a >= 0) & (b >= 0) & (a < len(v)) & (b < len(w))]
        a, b = j[at] + step * n[at], k[at] + step * n[at]
        at = at[(v[a] == w[b]) & (v[a] != 0)]
        n[at] += 1
    return n


def _stretches(v: np.ndarray, w: np.ndarray, j: np.ndarray, k: np.ndarray, edits: int, step: int) -> list[np.ndarray]:
    """For 0 to ``edits`` edits: words of ``v`` from ``j`` on that go along with ``w`` from ``k`` on, ending on an equal word.

    An edit replaces a word, or steps over an extra word of ``w``.
    """
    n = _equal_run(v, w, j, k, step)
    out = [n] * (edits + 1)
    if edits:
        inside = (k + step * n >= 0) & (k + step * n < len(w))
        inside[inside] &= w[(k + step * n)[inside]] != 0
        for replaced in (1, 0):
            nj, nk = j + step * (n + replaced), k + step * (n + 1)
            ok = inside & (j + step * n >= 0) & (j + step * n < len(v))
            ok[ok] &= v[(j + step * n)[ok]] != 0
            more = _stretches(v, w, nj[ok], nk[ok], edits - 1, step)
            for e in range(1, edits + 1):
                longer = out[e].copy()
                longer[ok] = np.maximum(longer[ok], np.where(more[e - 1] > 0, n[ok] + replaced + more[e - 1], 0))
                out[e] = longer
    return out


#: Words of a shard, words of the items that go to the executors at once, and pairs of places worked on at once.
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000
PAIRS = 1_000_000

_ARRAYS = "ids array<{kind}>, starts binary, flat binary, ord binary"
_FOUND = "doc_id {kind}, item_id bigint, verbatim int, longest int, doc_word int, item_word int"


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[Shard]:
    ids, docs, size, known = [], [], 0, {}
    for b in batches:
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            numbers = word_numbers(words(t), known)
            if not numbers:
                continue
            ids.append(i)
            docs.append(numbers)
            size += len(numbers)
            if size >= SHARD_WORDS:
                yield Shard.of(ids, docs)
                ids, docs, size, known = [], [], 0, {}
    if docs:
        yield Shard.of(ids, docs)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "doc_id")


def training_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ids, starts, flat, ord)``: a suffix array for each shard of the corpus, to be written once and searched often.

    It does not depend on any items. 12 bytes a word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in _shards(batches):
            yield pd.DataFrame({"ids": [s.ids], "starts": [s.starts.tobytes()], "flat": [s.flat.tobytes()], "ord": [s.order.astype(np.int32).tobytes()]})

    source = _texts(docs, key, text)
    return source.mapInPandas(run, _ARRAYS.format(kind=source.schema["doc_id"].dataType.simpleString()))


def search_arrays(arrays: DataFrame, items: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``find_leaks`` over stored ``training_arrays``; the corpus is not read again, however many items there are."""
    rule = rule or Rule()
    ship(arrays.sparkSession)

    def searched(block: Items) -> DataFrame:
        shared = arrays.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ids, starts, flat, order in zip(b["ids"], b["starts"], b["flat"], b["ord"], strict=True):
                    yield shared.value.search(Shard(list(ids), np.frombuffer(starts, np.int64), np.frombuffer(flat, np.uint64), np.frombuffer(order, np.int32).astype(np.int64)), rule)

        return arrays.mapInPandas(run, _FOUND.format(kind=arrays.schema["ids"].dataType.elementType.simpleString()))

    return _best([searched(b) for b in item_blocks(items)])


def item_blocks(items: DataFrame) -> list[Items]:
    """The items in blocks of bounded size, at least one."""
    bodies = item_bodies([(r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator()])
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for i, texts in bodies.items():
        for body in texts:
            if size > BLOCK_WORDS:
                blocks.append([])
                size = 0
            blocks[-1].append((i, body))
            size += len(body)
    return [Items(b) for b in blocks]


def _best(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.max(F.struct("verbatim", -F.col("doc_word"), -F.col("item_word"))).alias("v")
    best = out.groupBy("doc_id", "item_id").agg(first, F.max("longest").alias("longest"))
    return best.select("doc_id", "item_id", "v.verbatim", "longest", (-F.col("v.col2")).alias("doc_word"), (-F.col("v.col3")).alias("item_word"))


def find_leaks(docs: DataFrame, items: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, verbatim, longest, doc_word, item_word)`` of each document that holds a passage of an item.

    Each partition builds suffix arrays over shards of its documents; every suffix of every item is looked up in them by
    binary search, which gives its longest verbatim match and all places of matches of ``rule.seed`` words. Passages are
    grown around those, all places of a shard at once. Documents are read whole and move nowhere. One block of items
    (``BLOCK_WORDS``) is searched while the arrays are built; for more, the arrays are stored first and read for each block.

    ``verbatim`` is the longest run of equal words, which begins at ``doc_word`` and ``item_word`` (counted from 0, the item
    without what it shares with others at its start; the earliest on a tie); ``longest`` counts the words of the longest
    passage. Null and empty texts hold nothing; items with a null id or text, or fewer words than a passage, leak nowhere;
    repeated rows count once, and all texts of a repeated item count. Empty inputs give an empty result.
    """
    rule = rule or Rule()
    blocks = item_blocks(items)
    if len(blocks) > 1:
        return search_arrays(cut(training_arrays(docs, key, text)), items, rule)
    source = _texts(docs, key, text)
    shared = source.sparkSession.sparkContext.broadcast(blocks[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in _shards(batches):
            yield shared.value.search(s, rule)

    return _best([source.mapInPandas(run, _FOUND.format(kind=source.schema["doc_id"].dataType.simpleString()))])
