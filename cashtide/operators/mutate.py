"""Set-based changes to table snapshots: upsert, update, replace, stamp.

Snapshots are immutable, so each change is an expression over the old snapshot
and the incoming rows.  Upsert keys are unique on both sides, which keeps those
joins free of hot keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestamp_literal(run_ts: dt.datetime) -> Column:
    return F.lit(run_ts.isoformat(sep=" ")).cast("timestamp")


def stamp_updated(df: DataFrame, changed: Column, run_ts: dt.datetime | None, column: str = "updated_at") -> DataFrame:
    """Set the update time on changed rows; tables without the column pass through."""
    if run_ts is None or column not in df.columns:
        return df
    return df.withColumn(column, F.when(changed, timestamp_literal(run_ts)).otherwise(F.col(column)))


def one_row_per_key(incoming: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Refuse a key that arrives twice, or keep its last row by ``order``.

    The grouping combines map-side, so a key repeated millions of times reaches
    the reduce side as one row per task.
    """
    rest = [c for c in incoming.columns if c not in key]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    if order is not None:
        picked = F.max_by(row, F.col(order))
    else:
        picked = F.any_value(row)
    grouped = incoming.groupBy(*key).agg(picked.alias("_row"), F.count(F.lit(1)).alias("_n"))
    if order is None:
        message = F.concat(F.lit("key arrives more than once: "), F.to_json(F.struct(*key)))
        # The check rides on a column that is always selected, so it cannot be
        # pruned away.
        checked = F.when(F.col("_n") > 1, F.raise_error(message).cast(incoming.schema[key[0]].dataType)).otherwise(
            F.col(key[0])
        )
        grouped = grouped.withColumn(key[0], checked)
    return grouped.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in incoming.columns])


def upsert(
    target: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    update_cols: Sequence[str] = (),
    *,
    insert_only: bool = False,
    on_duplicate: str = "raise",
    order: str | None = None,
    unique: bool = False,
    small_batch: bool = False,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Insert new keys; on a match overwrite only ``update_cols``.

    ``insert_only`` leaves matches alone.  A key arriving twice raises, or with
    ``on_duplicate='last'`` its last row by ``order`` counts; pass ``unique``
    where the incoming key is unique by construction to skip that grouping.
    Columns the incoming side lacks are null on inserted rows.

    The default joins both sides once on the key.  With ``small_batch`` the
    target is not shuffled as long as the batch is small enough for Catalyst to
    broadcast it: matches are patched in place and the new keys are appended.
    """
    key = list(key)
    if not unique:
        if on_duplicate not in ("raise", "last"):
            raise ValueError(f"on_duplicate must be 'raise' or 'last', not {on_duplicate!r}")
        if on_duplicate == "last" and order is None:
            raise ValueError("on_duplicate='last' needs an order column")
        incoming = one_row_per_key(incoming, key, order if on_duplicate == "last" else None)
    types = {f.name: f.dataType for f in target.schema.fields}
    incoming = incoming.select(
        *[F.col(c).cast(types[c]).alias(c) for c in target.columns if c in incoming.columns],
    )
    missing = [c for c in target.columns if c not in incoming.columns]
    new_rows = incoming.withColumns({c: F.lit(None).cast(types[c]) for c in missing})
    new_rows = stamp_updated(new_rows, F.lit(True), run_ts)
    new_rows = stamp_updated(new_rows, F.lit(True), run_ts, "created_at").select(*target.columns)

    if insert_only:
        fresh = new_rows.join(target.select(*key), key, "left_anti")
        return target.unionByName(fresh)

    if small_batch:
        known = target.select(*key).join(incoming.select(*key), key, "left_semi")
        fresh = new_rows.join(known, key, "left_anti")
        patch = incoming.select(
            *[F.col(k).alias(f"_in_{k}") for k in key],
            *[F.col(c).alias(f"_in_{c}") for c in update_cols],
            F.lit(True).alias("_hit"),
        )
        match = [F.col(k) == F.col(f"_in_{k}") for k in key]
        patched = target.join(patch, match, "left")
        hit = F.col("_hit").isNotNull()
        patched = patched.withColumns({c: F.when(hit, F.col(f"_in_{c}")).otherwise(F.col(c)) for c in update_cols})
        return stamp_updated(patched, hit, run_ts).select(*target.columns).unionByName(fresh)

    old = target.select(*[F.col(c).alias(f"_old_{c}") for c in target.columns], F.lit(True).alias("_had"))
    new = new_rows.select(*[F.col(c).alias(f"_new_{c}") for c in target.columns], F.lit(True).alias("_got"))
    joined = old.join(new, [F.col(f"_old_{k}") == F.col(f"_new_{k}") for k in key], "full_outer")
    had, got = F.col("_had").isNotNull(), F.col("_got").isNotNull()

    def merged(name: str) -> Column:
        before, after = F.col(f"_old_{name}"), F.col(f"_new_{name}")
        if name == "updated_at" and run_ts is not None:
            return F.when(got, after).otherwise(before)
        if name in update_cols:
            return F.when(got, after).otherwise(before)
        return F.when(had, before).otherwise(after)

    return joined.select(*[merged(c).alias(c) for c in target.columns])


def update_where_distinct(
    target: DataFrame,
    source: DataFrame,
    key: Sequence[str],
    column: str,
    run_ts: dt.datetime | None = None,
) -> DataFrame:
    """Set ``column`` from the source where it differs, nulls compared as values.

    Rows without a source row keep what they have.
    """
    key = list(key)
    patch = source.select(*key, F.col(column).alias("_in_value"), F.lit(True).alias("_hit"))
    joined = target.join(patch, key, "left")
    changed = F.col("_hit").isNotNull() & ~F.col(column).eqNullSafe(F.col("_in_value"))
    stamped = stamp_updated(joined, changed, run_ts)
    return stamped.withColumn(column, F.when(changed, F.col("_in_value")).otherwise(F.col(column))).select(
        *target.columns
    )


def replace_from_date(target: DataFrame, fresh: DataFrame, date_col: str, as_of) -> DataFrame:
    """Drop the rows at or after a date (or date key) and append fresh ones; the
    history before it stays."""
    return target.filter(F.col(date_col) < F.lit(as_of)).unionByName(fresh.select(*target.columns))
