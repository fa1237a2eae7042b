"""Running sums and carried-forward values that survive a hot key.

A window over one key sorts all its rows in one task. Here a key's rows are cut
into chunks of the ordering number; windows run inside chunks, one summary row
per chunk carries the state on, and a join brings it back to the rows. A key
with a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add inclusive running values per key, in the order of an integral column.

    ``sums``  : name to a number; the total over all rows so far.
    ``lasts`` : name to a value; the latest one that is not null. A struct holding
                a null is a value, so a reset is ``struct(null)``.
    ``order`` must be a whole number, unique within a key; at most ``chunk_rows``
    rows of one key share a chunk.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    keys = list(keys)
    chunk = F.floor(F.col(order) / F.lit(chunk_rows)).alias("_chunk")
    chunked = df.select("*", chunk)
    part = [*keys, "_chunk"]

    in_chunk = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = chunked.select(
        "*",
        *[F.sum(F.coalesce(v, F.lit(0))).over(in_chunk).alias(f"_in_{n}") for n, v in sums.items()],
        *[F.last(v, ignorenulls=True).over(in_chunk).alias(f"_in_{n}") for n, v in lasts.items()],
    )

    totals = chunked.groupBy(*part).agg(
        *[F.sum(F.coalesce(v, F.lit(0))).alias(n) for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(n) for n, v in lasts.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *part,
        *[F.sum(n).over(earlier).alias(f"_from_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_from_{n}") for n in lasts],
    )

    joined = rows.join(carried, part, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{n}") + F.coalesce(F.col(f"_from_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_in_{n}"), F.col(f"_from_{n}")).alias(n) for n in lasts],
    )


def carry_with_reset(value: Column, is_set: Column, is_reset: Column) -> Column:
    """Input for ``lasts``: a set on a row beats a reset on the same row."""
    kind = F.struct(value.alias("value"))
    blank = F.struct(F.nullif(value, value).alias("value"))
    return F.when(is_set, kind).when(is_reset, blank)
