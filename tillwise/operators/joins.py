"""Left join onto a keyed table that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.scalars import named
from tillwise.session import materialize

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than
# HOT_SHARE hot keys whatever the data. That bounds the list of them.
HOT_SHARE = 1000
# Fewer rows than this are no burden for one task, whatever their share.
HOT_ROWS = 100_000
SPREAD = 64


def left_join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    rows_per_key: str | None = None,
    spread: int = SPREAD,
    hot_rows: int = HOT_ROWS,
    slot_by: Sequence[str] = (),
) -> DataFrame:
    """``left`` with the columns of ``right``, which has at most one row per key.

    ``rows_per_key`` names a column of ``right`` that says how many rows of ``left`` have
    the key; it is dropped. Without it the counts are taken from ``left``. Rows of hot
    keys, and rows without a key, are spread over ``spread`` partitions, and the matching
    row of ``right`` is repeated there. ``right`` is stored first, since its counts and
    its rows are both needed.

    The slot of a row depends on its partition's number, its keys and the columns ``slot_by``:
    few columns, so that the scan reads no more than what the result needs.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    right = materialize(right, "keyed")
    if rows_per_key is None:
        weights, weight = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "_rows"
        weights = materialize(weights.dropna(subset=keys), "weights")
    else:
        weights, weight = right, rows_per_key
        right = right.drop(rows_per_key)
    hot = _hot_keys(weights, weight, keys, hot_rows)

    # The partition number is part of the hash because all rows of a key may be copies.
    slot = F.pmod(
        F.xxhash64(F.spark_partition_id(), *[named(c) for c in [*keys, *slot_by]]),
        F.lit(spread),
    ).cast("int")
    apart = F.lit(False)
    for key in keys:
        apart = apart | named(key).isNull()
    home = F.array(F.lit(0))
    # Exploded even when it is just the one slot: a constant would drop out of the join key,
    # and the rows without a key would then meet in one partition.
    right_slot = F.explode(home)
    left_ready, right_ready = left, right
    if hot is not None:
        left_ready = left.join(F.broadcast(hot), keys, "left")
        right_ready = right.join(F.broadcast(hot), keys, "left")
        is_hot = F.coalesce("_hot", F.lit(False))
        apart = apart | is_hot
        everywhere = F.sequence(F.lit(0), F.lit(spread - 1))
        right_slot = F.explode(F.when(is_hot, everywhere).otherwise(home))
    added = [c for c in right.columns if c not in keys]
    joined = left_ready.withColumn("_slot", F.when(apart, slot).otherwise(0)).join(
        right_ready.withColumn("_slot", right_slot).drop("_hot"), [*keys, "_slot"], "left"
    )
    return joined.select(*[named(c) for c in [*left.columns, *added]])


def _hot_keys(
    weights: DataFrame, weight: str, keys: list[str], hot_rows: int
) -> DataFrame | None:
    """The keys above both limits as a local table of fewer than HOT_SHARE rows."""
    everything = weights.agg(F.sum(weight)).first()[0]
    if not everything:
        return None
    columns = [named(c) for c in keys]
    limit = max(everything // HOT_SHARE, hot_rows)
    hot = weights.where(F.col(weight) > limit).select(*columns)
    rows = hot.collect()
    if not rows:
        return None
    return weights.sparkSession.createDataFrame(rows, hot.schema).withColumn("_hot", F.lit(True))
