"""Changes between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.core import cut


#: Deliveries that are sent to every task.
MOST_BROADCAST = 100_000


def hash_value(h: Column) -> Column:
    """A hash without its notation: case, outer blanks and a leading algorithm name do not matter; null stays null."""
    return F.regexp_replace(F.lower(F.trim(h)), r"^(?:sha-?\d+\s*[:=\-]|0x)\s*", "")


def deliveries(rows: DataFrame, scope: str, number: str) -> DataFrame:
    """``(scope, number, idx, next_no)``: each delivery with its place in the order of its scope."""
    w = Window.partitionBy(scope).orderBy(number)
    return rows.select(scope, number).distinct().select(scope, number, F.row_number().over(w).alias("idx"), F.lead(number).over(w).alias("next_no"))


def snapshot_changes(
    rows: DataFrame,
    scope: str = "repo",
    number: str = "snapshot_no",
    key: tuple[str, ...] = ("file_path", "qualified_name"),
    content: str = "source_hash",
    version: str = "loaded_at",
) -> DataFrame:
    """``(scope, number, *key, change_kind)``: what each delivery adds, removes or changes against the one before it.

    One window per key over the delivery index: a lagged hash shows a change, a gap in the index a removal and a later
    addition. Only the keys' own rows meet in a task, so the size of a delivery or of a scope does not matter, and rows move
    once: what counts of a delivery and the window share one hash partitioning by key. The table of deliveries goes to
    every task while it has ``MOST_BROADCAST`` rows at most; a longer one is joined by shuffling.

    Rows with a null scope or number belong to no delivery and are left out. Null key parts are values like any other.
    Of several rows for a key in a delivery the one with the latest ``version`` counts (null is earliest; on a tie the
    greatest hash). A null hash equals only null. The first delivery of a scope has no changes; empty in, empty out.
    """
    rows = rows.where(F.col(scope).isNotNull() & F.col(number).isNotNull())
    order = cut(deliveries(rows, scope, number))
    order = F.broadcast(order) if order.count() <= MOST_BROADCAST else order
    moved = rows.select(scope, number, *key, F.col(version).alias("_v"), hash_value(F.col(content)).alias("_h")).repartition(scope, *key)
    state = moved.groupBy(scope, number, *key).agg(F.max(F.struct("_v", "_h")).alias("b")).select(scope, number, *key, F.col("b._h").alias("h"))
    placed = state.join(order, [scope, number])
    w = Window.partitionBy(scope, *key).orderBy("idx")
    seen = placed.select(
        scope,
        number,
        *key,
        "idx",
        "next_no",
        "h",
        F.lag("idx").over(w).alias("before"),
        F.lag("h").over(w).alias("old"),
        F.lead("idx").over(w).alias("after"),
    )
    came = (
        F.when((F.col("idx") > 1) & (F.col("before").isNull() | (F.col("before") < F.col("idx") - 1)), "added")
        .when((F.col("before") == F.col("idx") - 1) & ~F.col("old").eqNullSafe(F.col("h")), "changed")
    )
    gone = F.when(F.col("next_no").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("idx") + 1)), "removed")
    events = F.array(F.struct(F.col(number).alias("no"), came.alias("kind")), F.struct(F.col("next_no").alias("no"), gone.alias("kind")))
    return (
        seen.select(scope, *key, F.explode(F.filter(events, lambda e: e["kind"].isNotNull())).alias("e"))
        .select(scope, F.col("e.no").alias(number), *key, F.col("e.kind").alias("change_kind"))
    )
