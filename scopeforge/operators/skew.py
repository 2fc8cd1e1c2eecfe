"""Join strategies for skewed keys and size-checked broadcasts.

* ``broadcast_if_small``: broadcast a side only after measuring that it holds at
  most ``max_rows`` rows (the count stops early through a LIMIT) and ``max_bytes`` of
  values.
* ``salted_join``: keys that may hold a large share of the big side (a common
  symbol name, one huge file) are split into as many sub-keys as their own rows need
  at ``min_rows`` a task, and the few matching rows of the small side are replicated to
  every sub-key of theirs.  At most ``total / min_rows`` keys are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 200 << 20
#: Rows of one key that a task takes.
SALT_ROWS = 1_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """Side of an equi-join that grows with the input and is joined by shuffling it.

    Without this Spark may broadcast it for its file size, and a few MB of well packed
    columns can be millions of rows in the driver."""
    return df.hint("merge")


def count_at_most(df: DataFrame, max_rows: int) -> int:
    """Exact row count when it is <= max_rows, else max_rows + 1."""
    return df.limit(max_rows + 1).count()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, values = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    if rows <= max_rows and (values or 0) <= max_bytes:
        return F.broadcast(df), True
    return df, False


def hot_keys(big: DataFrame, keys: list[str], min_rows: int = SALT_ROWS) -> DataFrame:
    """(keys, _n): keys of more than ``min_rows`` rows of ``big``, with their number."""
    return big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                hot: DataFrame | None = None, min_rows: int = SALT_ROWS) -> DataFrame:
    """Equi-join on ``keys``; a key of n rows of ``big`` is spread over n / ``min_rows``
    tasks.  ``hot``: (keys, _n) of the keys to spread, if known."""
    if hot is None:
        hot = hot_keys(big, keys, min_rows)
    hot = hot.select(*keys, F.ceil(F.col("_n") / min_rows).cast("int").alias("_salts"))
    hot, _ = broadcast_if_small(hot)
    one = F.coalesce("_salts", F.lit(1))
    b = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), one).cast("int")).drop("_salts")
    s = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return b.join(s, [*keys, "_salt"], how).drop("_salt")
