"""One surviving record for each group of duplicates by declared trust, and truth discovery over field values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.core import cut

FIELDS = ("severity", "confidence", "cwe", "fixed_in")


def _one_of(c: str, *allowed: str) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin(*allowed), v)


def field_values() -> dict[str, Column]:
    """The value that each field of a finding holds, null if it holds none."""
    weakness = F.ltrim(F.regexp_extract(F.trim("cwe"), r"(?i)^(?:cwe-)?0*([0-9]+)", 1))
    fixed = F.trim("fixed_in")
    return {
        "severity": _one_of("severity", "low", "medium", "high", "critical"),
        "confidence": _one_of("confidence", "low", "medium", "high"),
        "cwe": F.when((weakness != "") & (weakness != "0"), F.concat(F.lit("CWE-"), weakness)),
        "fixed_in": F.when(fixed.rlike("^[0-9]"), fixed),
    }


def group_members(groups: DataFrame, findings: DataFrame, trust: DataFrame) -> DataFrame:
    """``(group_id, finding_id, source, trust, reported_at, <field>...)``: each existing member of a group once."""
    pairs = groups.select("group_id", F.explode("members").alias("finding_id")).dropna().distinct()
    source = F.lower(F.trim("source"))
    values = field_values()
    rows = findings.select("finding_id", source.alias("source"), "reported_at", *(v.alias(k) for k, v in values.items()))
    one = rows.groupBy("finding_id").agg(F.max(F.struct("reported_at", "source", *FIELDS)).alias("r")).select("finding_id", "r.*")
    known = trust.select(F.lower(F.trim("source")).alias("source"), F.col("trust")).dropna().groupBy("source").agg(F.max("trust").alias("trust"))
    known = cut(known)
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    return pairs.join(one, "finding_id").join(known, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def claims(members: DataFrame) -> DataFrame:
    """``(group_id, field, value, source, trust, reported_at, finding_id)``: what each member says of each field."""
    said = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))).alias("s")
    return members.select("group_id", "source", "trust", "reported_at", "finding_id", said).select("*", "s.*").drop("s").where(F.col("value").isNotNull())


#: A table of voters goes to every task up to this many rows; a longer one is joined by shuffling.
MOST_BROADCAST = 10_000
#: Supports are compared and shown to this many decimals, so that the order of sums does not settle ties.
DECIMALS = 9


@dataclass
class Truth:
    """``values``: group_id, field, value, support, claims of the best value of each field. ``weights``: voter, reliability."""

    values: DataFrame
    weights: DataFrame
    rounds: int
    converged: bool


def discover_truth(said: DataFrame, declared: bool = False, rounds: int = 100, tolerance: float = 1e-3, prior: float = 0.8) -> Truth:
    """Iterative truth discovery: votes weighted by the reliability of voters, and reliabilities by the votes they won.

    Free (``declared`` false), voters are the sources. A value's support is the share of its voters' reliability among all
    votes on the field, ties go to the greatest value; a source's reliability is the mean support of the values it voted for,
    ``prior`` at first.

    ``declared``, voters are the ranks of trust that sources were given (sources of one rank can't be told apart, and those
    without a rank have 0). A value is as strong as its strongest vote: the most reliable voter's, of one voter's the latest
    reported one, then that of the greatest finding. A voter's reliability is its rank plus half the share of its claims
    that won, so of whole ranks an estimate moves within its own and never past another: what was declared is a bound, not
    only a start. The values are then those of ``survivors``, which needs no estimates; only the reliabilities are new.

    Rounds end when no reliability moves by more than ``tolerance``; ``converged`` tells whether one did not within
    ``rounds``. Votes are counted per voter and value before any join, so however large a group, what moves in a round is
    a row for each different vote. No claims give two empty results.
    """
    voter = F.coalesce(F.col("trust").cast("string"), F.lit("0")) if declared else F.coalesce("source", F.lit(""))
    latest = F.max(F.struct("reported_at", "finding_id")).alias("latest")
    votes = cut(said.groupBy("group_id", "field", "value", voter.alias("voter")).agg(F.count("*").alias("n"), latest))
    start = F.col("voter").cast("double") if declared else F.lit(prior)
    weight = cut(votes.select("voter").distinct().withColumn("reliability", start))
    small = weight.count() <= MOST_BROADCAST
    converged = False
    for k in range(1, rounds + 1):
        now = votes.join(F.broadcast(weight) if small else weight, "voter")
        new = cut(_agreement(now, _strongest(now)) if declared else _mean_support(now))
        moved = new.join(weight.withColumnRenamed("reliability", "old"), "voter").agg(F.max(F.abs(F.col("reliability") - F.col("old"))).alias("m")).first()["m"]
        weight = new
        if moved is None or moved <= tolerance:
            converged = True
            break
    now = votes.join(F.broadcast(weight) if small else weight, "voter")
    if declared:
        return Truth(_strongest(now), weight, k, converged)
    best = _supports(now).groupBy("group_id", "field").agg(F.max(F.struct(F.round("support", DECIMALS).alias("support"), "value")).alias("b"), F.sum("n").alias("claims"))
    return Truth(best.select("group_id", "field", "b.value", "b.support", "claims"), weight, k, converged)


def _strongest(now: DataFrame) -> DataFrame:
    vote = F.struct("reliability", "latest", "value")
    best = now.groupBy("group_id", "field").agg(F.max(vote).alias("b"), F.sum("n").alias("claims"))
    return best.select("group_id", "field", "b.value", F.col("b.reliability").alias("support"), "claims")


def _agreement(now: DataFrame, best: DataFrame) -> DataFrame:
    """``(voter, reliability)``: the rank and half the share of claims that won."""
    j = now.join(best.select("group_id", "field", F.col("value").alias("won")), ["group_id", "field"])
    share = F.sum(F.when(F.col("value") == F.col("won"), F.col("n")).otherwise(0)) / F.sum("n")
    heard = j.groupBy("voter").agg((F.col("voter").cast("double") + share / 2).alias("estimate"))
    return now.select("voter").distinct().join(heard, "voter", "left").select("voter", F.coalesce("estimate", F.col("voter").cast("double")).alias("reliability"))


def _supports(now: DataFrame) -> DataFrame:
    weighed = now.groupBy("group_id", "field", "value").agg(F.sum(F.col("n") * F.col("reliability")).alias("w"), F.sum("n").alias("n"))
    total = weighed.groupBy("group_id", "field").agg(F.sum("w").alias("t"))
    return weighed.join(total, ["group_id", "field"]).select("group_id", "field", "value", "n", (F.col("w") / F.col("t")).alias("support"))


def _mean_support(now: DataFrame) -> DataFrame:
    s = _supports(now).select("group_id", "field", "value", "support")
    return now.join(s, ["group_id", "field", "value"]).groupBy("voter").agg((F.sum(F.col("n") * F.col("support")) / F.sum("n")).alias("reliability"))


def survivors(groups: DataFrame, findings: DataFrame, trust: DataFrame) -> DataFrame:
    """``(group_id, severity, confidence, cwe, fixed_in)`` of each group with two or more existing members.

    Every field is settled on its own by the best member that has a value for it: of the highest declared trust, then
    reported last, then of the greatest id; '' if none has one. That order leaves nothing open, so nothing is estimated.
    Null or unknown sources have trust 0 and a null ``reported_at`` is earliest. Repeated groups, members and findings count
    once (of findings that share an id the one reported last counts); null ids and members that never arrived do not
    count. Empty inputs give an empty result; columns beyond those used are ignored.
    """
    best = [F.max(F.when(F.col(f).isNotNull(), F.struct("trust", "reported_at", "finding_id", f))).alias(f) for f in FIELDS]
    merged = group_members(groups, findings, trust).groupBy("group_id").agg(F.count("*").alias("members"), *best)
    return merged.where("members >= 2").select("group_id", *(F.coalesce(F.col(f)[f], F.lit("")).alias(f) for f in FIELDS))
