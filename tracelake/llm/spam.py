"""Keyword-stuffed pages, link lists and product tags: robust outliers in text features, in the direction of spam.

Five features of every text give a robust model of each language; texts far from their language's centre, in the direction
in which the features rise with spam, are candidates. They alone are read unit by unit to confirm that more than half of
the text is spam.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.core import cut, ship, spread

#: Common function words of each language.
FUNCTION_WORDS = {
    "en": frozenset("the a an of to and in is it its for on that this these those with as are was were be been being by or at from not no but if so which who whom whose when than then can could may might must has have had will would should shall only each any all both into over under more most other same out up down off do does did there here their they them you your we us our he she his her him i my me what how where why while after before because about between through during against also very still just even yet too such until since per via whether nor never always every some one".split()),
    "de": frozenset("der die das den dem des ein eine einer einem einen eines und oder aber nicht kein keine ist sind war waren wird werden wurde hat haben hatte im in ins am an auf aus bei beim bis durch für gegen mit nach ohne über um unter von vom vor zu zum zur als auch daher dann dass da so wie wenn weil was wer wo er sie es ihn ihm ihr ihre sein seine sich wir ich du man nur noch schon sehr jeder jede jedes jeden jedem alle danach dadurch damit bleibt kann muss soll".split()),
    "fr": frozenset("le la les l un une des du de d et ou mais ne pas n plus que qu qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu se s son sa ses leur leurs mon ma mes est sont été a ont était être avoir au aux en dans par pour sur sous avec sans chez vers depuis entre si comme puis donc car ni y lui même aussi très tout toute tous chaque aucun aucune peut doit reste".split()),
    "es": frozenset("el la los las lo un una unos unas de del al a y e o u pero no ni que quien cual cuyo donde cuando como porque si se su sus le les me te nos mi tu es son fue era ser está están ha han había en por para con sin sobre entre desde hasta hacia tras ya más muy también solo cada todo toda todos ninguno ninguna algún este esta estos estas ese esa eso pues así puede debe conviene".split()),
    "cjk": frozenset("的了在是和与或从到并把将被也不都很就这那其及于以因为所该个之而则请会要には をにがでともへやのはかしてたするれるいなこそあまでよりかられた"),
}
_WORD = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W_\u3040-\u30ff\u4e00-\u9fff]+(?:[_'\u2019./:@-]+[^\W_\u3040-\u30ff\u4e00-\u9fff]+)*")
_CJK = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_PLAIN = re.compile(r"[^\W\d_]{2,}")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\((?:[^()\s]*)\)|<a\b[^>]*>(.*?)</a>|<?(?:https?|ftp)://[^\s<>|,]+>?|\bwww\.[^\s<>|,]+", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_ITEM = re.compile(r"(?<=>)\s*(?=<li\b)|<br\s*/?>|(?<=</p>)|(?<=</div>)|(?<=</li>)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_LIST_MARK = re.compile(r"^\s*(?:[-*+•·>#]+|\(?\d{1,4}[.)])\s*")
_SELL = (
    re.compile(r"\bSKU\b|\bEAN\b|\bASIN\b|\bart(?:icle)?[ .-]*no\b", re.I),
    re.compile(r"(?:[$€£¥]\s?\d)|\b\d+[.,]\d\d\s?(?:EUR|USD|GBP|CHF|[$€£])", re.I),
    re.compile(r"\b(?:in|out of|low) stock\b|\bsold out\b|\badd to (?:cart|basket)\b|\bfree shipping\b|\bbuy now\b", re.I),
    re.compile(r"\btags?\s*:", re.I),
)
#: Lines of code, tables, logs, dependency pins and change lists: repetitive by nature, never keywords.
_MATTER = re.compile(
    r"^\s*(?:\||(?:from|import|def|class|return|const|let|var|export|function|if|for|while|try|except|else|elif|with|assert|raise)\b"
    r"|@\w|\d{4}-\d\d-\d\d[ T]\d|\[?\d\d:\d\d:\d\d|[-*+]?\s*v?\d+\.\d+(?:\.\d+)*\s*[:\u2013-]|[\w.-]+\s*(?:==|>=|<=|~=)\s*\d)"
)
_CODE = re.compile(r"[(){}\[\];=<>\\]")
_BREAKS = re.compile(r"[|、，；・\u00bb\u00ab\u00b7\u2022;,/>]+|\s[-\u2013]\s")

#: Pairs of Chinese or Japanese characters count as keywords in units with at most this share of function characters;
#: common words recur in prose, which has more of these.
MOST_PARTICLES = 0.05

FEATURES = ("density", "repetition", "monotony", "function_gap", "tagging")
_TABLE = "doc_id {kind}, group string, density double, repetition double, monotony double, function_gap double, tagging double"
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_HASHTAG = re.compile(r"(?<![\w&/#])#\w{2,}")
_OFFER_WORDS = frozenset("sku ean asin eur usd gbp chf stock sold cart basket shipping tag tags".split())
#: Characters that one sign of an offer stands for.
_OFFER_CHARS = 16


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


_ANY = frozenset().union(*(v for k, v in FUNCTION_WORDS.items()))
_NAMES = tuple(FUNCTION_WORDS)
#: The languages, by their numbers, that a function word belongs to.
_OF_WORD = {w: tuple(i for i, n in enumerate(_NAMES) if w in FUNCTION_WORDS[n]) for w in _ANY}
#: Share of function words from which a text counts as one of a language.
LEAST_COVER = 0.05


def features(text: str) -> tuple[str, float, float, float, float, float] | None:
    """(language, density, repetition, monotony, function gap, tagging) of a text; null for a blank one.

    density: share of characters in links; repetition: share of words in content word pairs that recur; monotony: 1 minus
    the entropy of words against its maximum; function gap: 1 minus the share of function words, of three in ten at most;
    tagging: share of characters in hashtags and signs of offers. The language is the one whose function words cover most,
    as declared ones are often wrong. All lie between 0 and 1, to three decimals.
    """
    total = _weight(text)
    if not total:
        return None
    density = tagging = 0.0
    body = text
    if "](" in text or "://" in text or "www." in text or "<a" in text or "<A" in text:
        body = _LINK.sub(" ", text)
        density = (len(text) - len(body)) / len(text)
    if "<" in body:
        body = _TAG.sub(" ", body)
    if "#" in body:
        tagging = sum(map(len, _HASHTAG.findall(body)))
    low = body.lower()
    words = _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)
    n = len(words)
    counts = Counter(words)
    known = [0] * len(_NAMES)
    spread_ = 0.0
    for w, c in counts.items():
        if c > 1:
            spread_ += c * math.log2(c)
        if w in _OF_WORD:
            for i in _OF_WORD[w]:
                known[i] += c
    offers = sum(counts[w] for w in _OFFER_WORDS & counts.keys()) + sum(map(body.count, "$€£¥"))
    tagging = min((tagging + _OFFER_CHARS * offers) / total, 1.0)
    most = max(known)
    lang = _NAMES[known.index(most)] if n and most / n >= LEAST_COVER else "none"
    gap = 1 - min(most / n / 0.3, 1.0) if n else 1.0
    monotony = spread_ / (n * math.log2(n)) if n > 1 else 0.0
    pairs = Counter(zip(words, words[1:], strict=False))
    recur = sum(c for (a, b), c in pairs.items() if c > 2 and a not in _ANY and b not in _ANY)
    return lang, round(density, 3), round(recur / n if n else 0.0, 3), round(monotony, 3), round(gap, 3), round(tagging, 3)


def _units(text: str) -> list[str]:
    """Lines, list items and sentences; runs of short lines without punctuation belong together."""
    out: list[str] = []
    short: list[str] = []
    for line in text.splitlines():
        for item in _ITEM.split(line) if "<" in line else (line,):
            if not item.strip():
                continue
            if len(item) < 60 and item.count(" ") < 6 and not _LINK.search(item) and item.rstrip()[-1:] not in ".!?:。" and not _MATTER.match(item):
                short.append(item)
                continue
            if short:
                out.append("\n".join(short))
                short = []
            out.extend(p for p in (_SENTENCE.split(item) if not _MATTER.match(item) else (item,)) if p.strip())
    if short:
        out.append("\n".join(short))
    return out


def _weight(text: str) -> int:
    return len(text) - sum(map(text.count, " \t\n\r"))


def spam_share(text: str) -> float:
    """Share of characters in units that are links without description, product tags, keyword runs, or hollow sentences
    around recurring keywords.

    Where half of the text or more is code, logs, tables and the like, which are none of these, the text can't be
    more than half spam, and 0 stands for its share.
    """
    units = _units(text)
    matter = [bool(_MATTER.match(u)) or len(_CODE.findall(u)) > 0.01 * len(u) for u in units]
    if 2 * sum(_weight(u) for u, m in zip(units, matter, strict=True) if not m or _LINK.search(u) or "#" in u or sum(bool(r.search(u)) for r in _SELL) >= 2) <= sum(map(_weight, units)):
        return 0.0
    by_unit = [words_of(_TAG.sub(" ", _LINK.sub(" ", u)) if "<" in u or "](" in u or "://" in u or "www." in u else u) for u in units]
    total = sum(map(_weight, units))
    if not total:
        return 0.0
    content = []
    counts: Counter = Counter()
    for ws in by_unit:
        counts.update(ws)
        signs = [w for w in ws if _CJK.match(w)]
        bare = sum(w in _ANY for w in signs) <= MOST_PARTICLES * len(signs)
        content.append([w if w not in _ANY and (bare if _CJK.match(w) else _PLAIN.fullmatch(w)) else None for w in ws])
    pairs: Counter = Counter()
    gaps: dict = {}
    last: dict = {}
    at = 0
    for ws in content:
        for i in range(len(ws) - 1):
            if ws[i] and ws[i + 1]:
                p = (ws[i], ws[i + 1])
                pairs[p] += 1
                if p in last:
                    gaps.setdefault(p, []).append(at + i - last[p])
                last[p] = at + i
        at += len(ws)
    dense = {p for p, g in gaps.items() if pairs[p] >= 5 and sorted(g)[len(g) // 2] <= 9}

    linked = tagged = stuffed = links = 0
    for u, ws, cs, m in zip(units, by_unit, content, matter, strict=True):
        size, n = _weight(u), len(ws)
        functional = sum(w in _ANY for w in ws)
        found = _LINK.findall(u)
        if found and n <= 4 + len(found) and not _SELL[1].search(u):
            linked += size
            links += len(found)
            continue
        hashtags = _HASHTAG.findall(u)
        if sum(bool(r.search(u)) for r in _SELL) >= 2 or (len(hashtags) >= 3 and 2 * len(hashtags) >= n):
            tagged += size
            continue
        if not n or m:
            continue
        cover = [False] * n
        tight = [False] * n
        for i in range(n - 1):
            if cs[i] and cs[i + 1]:
                p = (cs[i], cs[i + 1])
                if pairs[p] >= 3:
                    cover[i] = cover[i + 1] = True
                    if p in dense:
                        tight[i] = tight[i + 1] = True
        covered = sum(cover) / n
        again = sum(c is not None and not _CJK.match(c) and counts[c] >= 3 for c in cs) / n
        plain = sum(c is not None for c in cs) / n
        segments = [s for s in _BREAKS.split(u) if s.strip()]
        short = n <= 5 * len(segments)
        if (
            (n >= 6 and functional / n <= 0.12 and plain >= 0.6 and (covered >= 0.5 or (n >= 12 and again >= 0.5)))
            or (len(segments) >= 6 and short and covered >= 0.4 and plain >= 0.5)
            or (len(segments) >= 20 and n <= 3 * len(segments) and functional / n <= 0.05 and plain >= 0.8)
            or sum(tight) / n >= 0.3
        ):
            stuffed += size
    if links < 2:
        linked = 0
    return (linked + tagged + stuffed) / total


def feature_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of features for each text that is not blank."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, *f) for i, t in zip(b["doc_id"], b["text"], strict=True) if t and (f := features(t))]
            yield pd.DataFrame(out, columns=["doc_id", "group", *FEATURES])

    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return spread(source, "doc_id").mapInPandas(run, _TABLE.format(kind=kind))


#: Least variance of a feature: most texts have no links or tags at all, and a spread of 0 has no distances.
FLOOR = 0.05**2
#: Upper 5 % point of the chi-squared distribution with as many degrees of freedom as there are features.
CUTOFF = 11.07


def _solve(rows: list[list[float]]) -> list[list[float]]:
    """Inverse of a small positive definite matrix."""
    n = len(rows)
    a = [list(r) + [float(i == j) for j in range(n)] for i, r in enumerate(rows)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n):
            if r != c and a[r][c]:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c], strict=True)]
    return [r[n:] for r in a]


#: A language's centre and spread count as much as those of all texts once it has this many texts; the weight grows evenly.
HALF_WEIGHT = 200
_POOL = "*"


@dataclass(frozen=True)
class Models:
    """Centre and precision matrix of each language; ``pool`` has those of all texts, for texts of no language."""

    of: dict[str, tuple[list[float], list[list[float]]]]
    pool: tuple[list[float], list[list[float]]]

    def measure(self, group: str, f) -> tuple[float, float]:
        """(squared robust distance, how far along the spam direction) of the features ``f``.

        All features grow with spam, so the direction is the one in which they all rise, in units of the language's spread.
        """
        centre, precision = self.of.get(group, self.pool)
        z = [x - c for x, c in zip(f, centre, strict=True)]
        distance = sum(z[i] * z[j] * precision[i][j] for i in range(len(z)) for j in range(len(z)))
        return distance, sum(x * math.sqrt(precision[i][i]) for i, x in enumerate(z))


def robust_models(table: DataFrame) -> Models | None:
    """Models from the inner half of each language and of all texts; null for an empty table.

    The inner half are the rows whose distance from the medians, in units of the median absolute deviations, is at most
    the median distance. Languages lean on all texts by a weight that falls evenly with their number, so no number of texts
    switches anything. All rows take part, by sums and exact medians: features have a thousand values at most and distances
    are counted on a scale of fixed steps, so a median is a bounded table of counts. There is a row for each language (six
    at most) and one for all texts; they are inverted on the driver, from figures rounded so that the order of sums is
    not seen.
    """
    counted = table.select("group", *FEATURES).where(F.col("group") != "none").unionByName(table.select(F.lit(_POOL).alias("group"), *FEATURES))
    med = counted.groupBy("group").agg(*(F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in FEATURES))
    off = counted.join(F.broadcast(med), "group")
    mad = off.groupBy("group").agg(*(F.percentile(F.round(F.abs(F.col(c) - F.col(f"m_{c}")), 4), F.lit(0.5)).alias(f"d_{c}") for c in FEATURES))
    far = sum(((F.col(c) - F.col(f"m_{c}")) ** 2) / (F.col(f"d_{c}") ** 2 * 2.198 + FLOOR) for c in FEATURES)
    off = off.join(F.broadcast(mad), "group").withColumn("far", F.round(F.log2(far + 1), 3))
    half = off.groupBy("group").agg(F.percentile("far", F.lit(0.5)).alias("half"))
    inner = off.join(F.broadcast(half), "group").where(F.col("far") <= F.col("half"))
    moments = [F.round(F.avg(c), 9).alias(f"a_{c}") for c in FEATURES] + [
        F.round(F.covar_pop(a, b), 9).alias(f"c_{i}_{j}") for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if j >= i
    ]
    rows = {r["group"]: r for r in inner.groupBy("group").agg(F.count("*").alias("n"), *moments).collect()}
    if not rows:
        return None
    n = range(len(FEATURES))

    def figures(r) -> tuple[list[float], list[list[float]]]:
        return [r[f"a_{c}"] for c in FEATURES], [[r[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in n] for i in n]

    def finished(centre, cov) -> tuple[list[float], list[list[float]]]:
        # 2.5 makes up for the spread that the inner half leaves out.
        return centre, _solve([[2.5 * cov[i][j] + FLOOR * (i == j) for j in n] for i in n])

    all_centre, all_cov = figures(rows[_POOL])
    of = {}
    for g, r in rows.items():
        if g != _POOL:
            w = r["n"] / (r["n"] + HALF_WEIGHT)
            centre, cov = figures(r)
            of[g] = finished([w * a + (1 - w) * b for a, b in zip(centre, all_centre, strict=True)], [[w * cov[i][j] + (1 - w) * all_cov[i][j] for j in n] for i in n])
    return Models(of, finished(all_centre, all_cov))


_SCORES = "doc_id {kind}, group string, " + ", ".join(f"{c} double" for c in FEATURES) + ", distance double, spamward double, share double"
#: Ids of candidates that are sent to every task; more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def _candidates(table: DataFrame, models: Models) -> DataFrame:
    """``(doc_id)`` of the rows of a feature table that are candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for i, group, *f in zip(b["doc_id"], b["group"], *(b[c] for c in FEATURES), strict=True):
                distance, spamward = models.measure(group, f)
                if distance > CUTOFF and spamward > 0:
                    keep.append(i)
            yield pd.DataFrame({"doc_id": keep}).astype(b.dtypes["doc_id"])

    return table.mapInPandas(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}")


def score(docs: DataFrame, candidates_only: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Features, ``distance``, ``spamward`` and ``share`` of each text that is not blank.

    ``share`` is worked out for candidates only: robust outliers (squared distance over ``CUTOFF``) that lie in a spam
    direction; others have null. Texts are read twice, for the models and to be measured. With ``candidates_only`` the second
    time takes only texts whose id is that of a candidate; the ids go to every task, or, if there are more than
    ``MOST_BROADCAST``, are joined by shuffling.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    table = cut(feature_table(docs, key, text))
    models = robust_models(table)
    source = spread(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "doc_id")
    if candidates_only and models:
        ids = cut(_candidates(table, models).distinct())
        source = source.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                f = features(t) if t else None
                if f:
                    distance, spamward = models.measure(f[0], f[1:])
                    candidate = distance > CUTOFF and spamward > 0
                    if candidate or not candidates_only:
                        out.append((i, *f, round(distance, 6), round(spamward, 6), round(spam_share(t), 6) if candidate else None))
            yield pd.DataFrame(out, columns=["doc_id", "group", *FEATURES, "distance", "spamward", "share"]).astype({"share": float})

    scored = source.mapInPandas(run, _SCORES.format(kind=kind))
    return scored.withColumn("share", F.when(~F.isnan("share"), F.col("share")))


def find_spam(docs: DataFrame) -> DataFrame:
    """``(doc_id, distance, spamward, share)`` of the documents that are spam.

    Candidates are robust outliers of their language that lie in a spam direction; the exact check that follows asks for
    more than half of the text in links, tags or keywords. Texts are read whole. Null, empty and blank texts are never spam;
    repeated rows stay repeated; an empty table gives an empty result.
    """
    return score(docs, candidates_only=True).where("share > 0.5").select("doc_id", "distance", "spamward", "share")
