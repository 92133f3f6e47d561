"""A join side that adaptive execution can line up with a split hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reshuffled(df: DataFrame, key: str) -> DataFrame:
    """`df`, an aggregate by `key`, to be shuffled anew when it is joined on `key`.

    The key is text or a whole number.

    Adaptive execution splits a hot key of the other side only if both sides are shuffled for the
    join itself. An aggregate is already partitioned by its key and would be joined in place, so
    the hot key would stay in one task. Computing the key anew hides that partitioning; the price
    is a second shuffle of the aggregate, which has one row per key.
    """
    # identities the optimizer does not simplify away
    is_text = df.schema[key].dataType.typeName() == "string"
    same = F.concat(key, F.lit("")) if is_text else F.col(key).bitwiseOR(0)
    return df.withColumn(key, same)
