"""Left join of a fact to a table keyed by the join key, robust to hot keys.

AQE's skew join only splits a skewed sort-merge join when both inputs are
fresh shuffle stages; a per-key aggregate on the right (the usual
"aggregate before join" shape) is not one. ``hot_split_left_join`` splits
the keys instead:

1. rows per key of the fact (a partial aggregate) and T = sqrt(N), as a
   scalar subquery;
2. hot keys (more than T rows: fewer than sqrt(N) of them, a proven bound)
   and their lookup rows are broadcast to the hot fact rows;
3. the other rows take the ordinary (shuffle) join, which has no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_split_left_join(fact: DataFrame, lookup: DataFrame, fact_key: str, lookup_key: str) -> DataFrame:
    counts = fact.groupBy(F.col(fact_key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n"))
    t = counts.agg(F.greatest(F.lit(1.0), F.sqrt(F.sum("_n"))).alias("t")).scalar()
    hot = counts.filter(F.col("_n") > t).select("_hk")
    hot_lookup = lookup.join(F.broadcast(hot), lookup[lookup_key] == F.col("_hk")).drop("_hk")
    tagged = fact.join(F.broadcast(hot), fact[fact_key] == F.col("_hk"), "left")
    hot_rows = (tagged.filter(F.col("_hk").isNotNull()).drop("_hk")
                .join(F.broadcast(hot_lookup), F.col(fact_key) == F.col(lookup_key), "left"))
    cold_rows = (tagged.filter(F.col("_hk").isNull()).drop("_hk")
                 .join(lookup, F.col(fact_key) == F.col(lookup_key), "left"))
    return hot_rows.unionByName(cold_rows)
