"""Scalar functions as column expressions; all of them stay in the JVM but for the version key."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates the parts of a hash basis.
UNIT = "\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def joined_hash(*parts: Column | str) -> Column:
    """SHA-256 over the parts with a unit separator between; a null part counts as ''."""
    return F.sha2(F.concat_ws(UNIT, *(F.coalesce(_col(p), F.lit("")) for p in parts)), 256)


def canonical_name(c: Column | str) -> Column:
    """A package name in canonical form."""
    return F.lower(F.regexp_replace(_col(c), "[-_.]+", "-"))


def import_name(c: Column | str) -> Column:
    return F.lower(F.translate(_col(c), "-", "_"))


def module_name(path: Column | str) -> Column:
    """Dotted module of a file; a package's ``__init__`` names the package."""
    dotted = F.translate(F.regexp_replace(_col(path), r"\.pyi?w?$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def first_part(c: Column | str) -> Column:
    return F.substring_index(_col(c), ".", 1)


def last_part(c: Column | str) -> Column:
    return F.substring_index(_col(c), ".", -1)


def absolute_module(package: Column | str, module: Column | str, level: Column | str) -> Column:
    """What a relative import of ``level`` dots means in ``package``; null above the root."""
    parts = F.split(_col(package), r"\.")
    keep = F.size(parts) - (_col(level) - 1)
    base = F.array_join(F.slice(parts, 1, F.greatest(keep, F.lit(0))), ".")
    joined = F.concat_ws(".", F.when(base != "", base), F.when(F.coalesce(_col(module), F.lit("")) != "", _col(module)))
    return F.when(_col(level) == 0, _col(module)).when(keep >= 0, joined)


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` below ``root``; null outside of it. A path that is relative already stays."""
    p = F.translate(_col(path), "\\", "/")
    prefix = root.rstrip("/") + "/"
    inside = F.regexp_replace(F.when(F.startswith(p, F.lit(prefix)), F.substr(p, F.lit(len(prefix) + 1))).when(~F.startswith(p, F.lit("/")), p), r"^(\./)+", "")
    return F.when(~inside.rlike(r"^\.\./|^\.\.$"), inside)


def cwe(c: Column | str) -> Column:
    """``CWE-<n>`` of 78, '78' or 'CWE-78: text'; null for zero and anything else."""
    n = F.regexp_extract(F.trim(_col(c).cast("string")), r"(?i)^(?:CWE-)?0*(\d+)", 1)
    return F.when((n != "") & (n != "0"), F.concat(F.lit("CWE-"), n))


def severity_of_score(score: Column | str) -> Column:
    """Bands of a CVSS score given as text or number; low where there is no score."""
    s = _col(score).try_cast("double")
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


#: Severity words of the scanners.
SEVERITY_WORDS = {
    "critical": "critical",
    "high": "high",
    "error": "high",
    "medium": "medium",
    "warning": "medium",
    "low": "low",
    "info": "low",
}


def severity_of_word(word: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SEVERITY_WORDS.items() for x in kv))
    return F.coalesce(table[F.lower(F.trim(_col(word)))], F.lit("low"))


def rank_of(c: Column | str, order: tuple[str, ...]) -> Column:
    """How far up a word stands in ``order`` (worst first): its length for the first word, 0 for an unknown one."""
    found = F.array_position(F.array(*(F.lit(x) for x in order)), F.lower(_col(c)))
    return F.coalesce(F.when(found > 0, F.lit(len(order)) - found + 1), F.lit(0)).cast("int")


def clean_text(c: Column | str, cap: int = 600) -> Column:
    return F.substr(F.regexp_replace(F.trim(_col(c)), r"\s+", " "), F.lit(1), F.lit(cap))


def backticked(c: Column | str) -> Column:
    """Names in backticks."""
    return F.regexp_extract_all(_col(c), F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))


def clamp(c: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _col(c)))


def is_remote(target: Column | str) -> Column:
    return _col(target).rlike(r"^(https?://|ssh://|git@|github\.com/)")


def folder_of(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


_RELEASE = re.compile(
    r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?(\d*))?(?:-(\d+)|[-_.]?(?:post|rev|r)[-_.]?(\d*))?(?:[-_.]?dev[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_STAGE = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "c", "rc": "c", "pre": "c", "preview": "c"}


def version_sort_key(version: str | None) -> str | None:
    """A text that sorts as PEP 440 orders versions; null for anything that is no version.

    Numbers are written with their length first, so that text order is number order.
    """
    m = _RELEASE.match(version.strip().lower()) if version is not None else None
    if not m:
        return None

    def num(s: str | None) -> str:
        s = (s or "0").lstrip("0") or "0"
        return f"{len(s):03d}{s}"

    parts = m[2].split(".")
    while len(parts) > 1 and not parts[-1].strip("0"):
        parts.pop()
    post = m[5] is not None or m[6] is not None
    dev = m[7] is not None
    pre = _STAGE[m[3]] + num(m[4]) if m[3] else ("A" if dev and not post else "z")
    key = num(m[1]) + "!" + "".join(f"{num(p)}." for p in parts)
    key += " " + pre + (" p" + num(m[5] or m[6]) if post else " o") + (" d" + num(m[7]) if dev else " e")
    local = "".join(("1" + num(x) if x.isdigit() else "0" + x) + "." for x in re.split(r"[-_.]", m[8])) if m[8] else ""
    return key + (" +" + local if local else " *")


def _version_keys(v: pd.Series) -> pd.Series:
    memo: dict = {}
    return pd.Series([memo[x] if x in memo else memo.setdefault(x, version_sort_key(x)) for x in v], dtype=object)


def version_key(c: Column | str) -> Column:
    return F.pandas_udf(_version_keys, "string")(_col(c))


def normalize_target(target: str) -> str:
    """A repository address as git takes it; ``github.com/x/y`` and ``x.git`` shorthands get their scheme."""
    t = target.strip()
    return "https://" + t if t.startswith("github.com/") else t


def location(path: Column | str, line: Column | str) -> Column:
    """``path:line``, the path alone for line 0 or null."""
    return F.when(F.coalesce(_col(line), F.lit(0)) > 0, F.concat_ws(":", _col(path), _col(line).cast("string"))).otherwise(_col(path))


def percent(c: Column | str) -> Column:
    """A share as ``12.3%``, a dash for null."""
    return F.when(_col(c).isNull(), "-").otherwise(F.format_string("%.1f%%", _col(c) * 100))
