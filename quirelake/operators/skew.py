"""A join that cuts hot keys into parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this share of the rows is dealt over several tasks; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def spread_null_safe(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, by: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each key, null where the keys are null, and its number of
    rows in ``weight``; null equals null. A hot key's row is repeated for each of its parts, and its rows are dealt over
    the parts by a hash of ``by``, so a key may hold any share of the rows."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    parts = F.greatest(F.ceil(F.col(weight) / F.lit(max(total * HOT_SHARE, 1.0))), F.lit(1)).cast("int")
    sized = keyed.withColumn("_parts", parts)
    right = sized.select([F.col(k).alias(f"_{k}") for k in keys] + [c for c in keyed.columns if c not in (*keys, weight)] + [F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_of")])
    hot = sized.filter("_parts > 1").select([F.col(k).alias(f"_{k}") for k in keys] + ["_parts"])
    same = lambda right_: [F.col(k).eqNullSafe(right_[f"_{k}"]) for k in keys]
    small = F.broadcast(hot)
    dealt = rows.join(small, same(small), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int"))
    dealt = dealt.drop(*[f"_{k}" for k in keys], "_parts")
    return dealt.join(right, [*same(right), F.col("_part") == F.col("_of")]).drop(*[f"_{k}" for k in keys], "_part", "_of")
