"""Row number and running sums in a global order, without a one-task window.

``Window.orderBy(...)`` with no (or a low-cardinality) partition key moves the
whole table into one task. This operator computes the same columns with one
shuffle of the rows:

1. ``repartitionByRange(n, group..., order...)`` cuts the rows into ``n``
   contiguous slices, sorted inside. The order must be total (end it with a
   unique key), so a score shared by a third of the rows is still cut into
   many slices by the key.
2. A row's place in its slice is ``monotonically_increasing_id``; running sums
   inside a slice are cumulative sums over its Arrow batches. Neither needs a
   window, so there is no second exchange.
3. The slices are written as Parquet to the shared checkpoint folder. Range
   bounds come from a random sample, so two evaluations of step 1 may cut
   differently; one written copy keeps the slices consistent, and a lost
   executor re-reads it.
4. Per (slice, group) first place and totals: one small aggregate of at most
   ``n + groups`` rows; exclusive prefix sums over the slices are the offsets.
5. The offsets are broadcast (that size bound) and added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import estimated_bytes, shuffle_partitions, write_shared

SLICE_BYTES = 256 << 20
MAX_SLICES = 100_000


def num_slices_for(df: DataFrame) -> int:
    """At least the session's shuffle partitions, and slices of about SLICE_BYTES."""
    return max(shuffle_partitions(df.sparkSession), min(MAX_SLICES, estimated_bytes(df) // SLICE_BYTES))


def _cumulative(names: Sequence[str]):
    """Append the running sum of each ``_v_{name}`` over a partition's batches."""

    def run(batches):
        carry = [0] * len(names)
        for batch in batches:
            sums = []
            for k, name in enumerate(names):
                values = batch.column(batch.schema.get_field_index(f"_v_{name}")).fill_null(0).to_numpy(zero_copy_only=False)
                run_sum = np.cumsum(values) + carry[k]
                carry[k] = int(run_sum[-1]) if len(run_sum) else carry[k]
                sums.append(pa.array(run_sum, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], [*batch.schema.names, *(f"_c_{n}" for n in names)])

    return run


def sliced(df: DataFrame, order_by: Sequence[Column], groups: Sequence[str], sums: Mapping[str, Column], num_slices: int | None = None) -> DataFrame:
    """Rows in sorted slices with ``__slice``, ``__pos`` and, for each sum, the value ``_v_`` and its
    running total ``_c_`` inside the slice: one exchange, before the slices are written."""
    keys = [F.col(g) for g in groups]
    ranged = df.repartitionByRange(num_slices or num_slices_for(df), *keys, *order_by).sortWithinPartitions(*keys, *order_by)
    out = ranged.withColumns({"__slice": F.spark_partition_id(), "__pos": F.monotonically_increasing_id(),
                              **{f"_v_{n}": e.cast("bigint") for n, e in sums.items()}})
    if sums:
        schema = T.StructType([*out.schema.fields, *(T.StructField(f"_c_{n}", T.LongType()) for n in sums)])
        out = out.mapInArrow(_cumulative(list(sums)), schema)
    return out


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    partition_by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    rank_col: str = "rank",
    num_slices: int | None = None,
    totals_prefix: str | None = None,
) -> DataFrame:
    """Add ``rank_col`` (1-based bigint row number inside ``partition_by`` in
    ``order_by`` order) and one running-sum column per entry of ``sums``
    (integers, inclusive of the current row). With ``totals_prefix`` the group's row
    count (``{prefix}n``) and full sums (``{prefix}{name}``) are added too, read
    from the same small offsets table (no extra pass over the data)."""
    sums = dict(sums or {})
    groups = list(partition_by)
    keys = ["__slice", *groups]
    local = write_shared(sliced(df, order_by, groups, sums, num_slices), "slices")

    totals = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("__pos").alias("__first"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        # what the slice had summed before the group's first row
        *[F.min_by(F.col(f"_c_{n}") - F.coalesce(f"_v_{n}", F.lit(0)), "__pos").alias(f"_b_{n}") for n in sums],
    )
    scope = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = scope.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if totals_prefix is not None:
        extra = [F.sum("_n").over(scope).alias(f"{totals_prefix}n")] + [
            F.sum(f"_t_{n}").over(scope).alias(f"{totals_prefix}{n}") for n in sums
        ]
    offsets = totals.select(
        *keys, "__first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("__off_n"),
        *[(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) - F.col(f"_b_{n}")).alias(f"_off_{n}") for n in sums],
        *extra,
    )
    out = local.join(F.broadcast(offsets), keys).withColumn(
        rank_col, (F.col("__pos") - F.col("__first") + F.lit(1) + F.col("__off_n")).cast("bigint")
    )
    out = out.withColumns({n: F.col(f"_c_{n}") + F.col(f"_off_{n}") for n in sums})
    return out.drop("__slice", "__pos", "__first", "__off_n", *[f"_{x}_{n}" for n in sums for x in ("v", "c", "off")])
