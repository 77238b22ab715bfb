"""Keyed upserts: what a load adds, changes or leaves alone, and the next table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _differs(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns], F.lit(False))


def _same_key(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])


def _singly(new: DataFrame, key: list[str]) -> DataFrame:
    """`new`, failing with the key where two rows have one; counted on the partitioning that the join needs anyway."""
    several = F.count(F.lit(1)).over(W.partitionBy(*key)) > 1
    named = F.raise_error(F.concat(F.lit("more than one new row for the key "), F.to_json(F.struct(*key)))).cast("boolean")
    return new.withColumn("_several", several).where(F.when(F.col("_several"), named).otherwise(True)).drop("_several")


def _settled(both: DataFrame, old: list[str], new: list[str], key: list[str], compare: list[str], as_of: Column | None, touch: str | None, stamp: str | None,
             child: Column | None = None) -> DataFrame:
    """Columns `old` and the status of joined rows o and n, which have _in_old and _in_new where they are there."""
    is_new, is_old = F.col("n._in_new").isNotNull(), F.col("o._in_old").isNotNull()
    changed = _differs(compare) if child is None else _differs(compare) | child
    status = F.when(is_new & ~is_old, "added").when(is_new & changed, "updated").when(is_new, "unchanged")
    times = {c for c in (stamp, touch) if c}
    out = []
    for c in old:
        if c in key:
            value = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        elif c in times and as_of is not None:
            moved = status.isin("added", "updated") if c == stamp else is_new
            value = F.when(moved, as_of).otherwise(F.col(f"o.{c}"))
        elif c in new:
            taken = is_new if c in compare else (is_new & ~is_old)
            value = F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        else:
            value = F.col(f"o.{c}")
        out.append(value.alias(c))
    return both.select(*out, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], compare: list[str],
           as_of: Column | None = None, touch: str | None = None, also_changed: DataFrame | None = None,
           stamp: str | None = "updated_at") -> DataFrame:
    """Next table plus a status column: added, updated, unchanged, or null for rows the load did not name.

    Keys match null-safely. `stamp` moves only on a change; `touch` names a time
    that every visited row gets. Columns outside `compare` keep their stored
    value. `also_changed` lists keys whose child rows changed. Two rows of `new`
    with one key are an error that names the key.
    """
    new = _singly(new, key)
    on = _same_key(key)
    # Only stored rows that the load names are compared; a small load leaves the others where they are.
    named_keys = new.select(*key).distinct().alias("n")
    o = old.alias("o").join(named_keys, on, "left_semi").withColumn("_in_old", F.lit(True)).alias("o")
    rest = old.alias("o").join(named_keys, on, "left_anti").withColumn("status", F.lit(None).cast("string"))
    n = new.withColumn("_in_new", F.lit(True)).alias("n")
    both = o.join(n, on, "full_outer")
    child = None
    if also_changed is not None:
        marks = also_changed.select(*key).distinct().withColumn("_child", F.lit(True)).alias("c")
        both = both.join(
            marks, reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]), "left"
        )
        child = F.coalesce(F.col("c._child"), F.lit(False))
    return _settled(both, old.columns, new.columns, key, compare, as_of, touch, stamp, child).unionByName(rest)


def upsert_stored(old: DataFrame, new: DataFrame, id: str, key: list[str], compare: list[str],
                  as_of: Column | None = None, touch: str | None = None, stamp: str | None = "updated_at") -> DataFrame:
    """upsert() of a large load into a table that is stored in buckets of `id` (sources.tables.save_bucketed).

    One join on the id, which both sides compute alike from the natural key, so the
    stored side is read in its buckets and not moved; only the load is. An id that two
    natural keys share is an error.
    """
    new = _singly(new, [id])
    both = old.withColumn("_in_old", F.lit(True)).alias("o").join(new.withColumn("_in_new", F.lit(True)).alias("n"), F.col(f"o.{id}") == F.col(f"n.{id}"), "full_outer")
    clash = F.col("o._in_old") & F.col("n._in_new") & ~_same_key(key)
    failed = F.raise_error(F.concat(F.lit("two natural keys have the id "), F.col(f"o.{id}").cast("string"))).cast("boolean")
    both = both.where(F.when(clash, failed).otherwise(True))
    return _settled(both, old.columns, new.columns, [id, *key], compare, as_of, touch, stamp)


def reconcile(old: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Child rows with status added, deleted or unchanged, for the parents a load names.

    Children of other parents are kept and have a null status.
    """
    columns = old.columns
    on = _same_key(columns)
    visited = parents.select(parent).unionByName(new.select(parent)).distinct()
    rest = old.join(visited, parent, "left_anti").distinct().withColumn("status", F.lit(None).cast("string"))
    both = old.join(visited, parent, "left_semi").distinct().withColumn("_o", F.lit(True)).alias("o").join(
        new.select(*columns).distinct().withColumn("_n", F.lit(True)).alias("n"), on, "full_outer"
    ).select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns], "_o", "_n")
    named = parents.select(parent).distinct().withColumn("_p", F.lit(True))
    return both.join(named, parent, "left").select(
        *columns,
        F.when(F.col("_n") & F.col("_o").isNull(), "added")
        .when(F.col("_o") & F.col("_n").isNull() & F.col("_p"), "deleted")
        .when(F.col("_n") & F.col("_o"), "unchanged").alias("status"),
    ).unionByName(rest.select(*columns, "status"))


def next_table(diff: DataFrame) -> DataFrame:
    """Rows to store after a diff: everything that is not marked deleted."""
    return diff.where(F.coalesce(F.col("status"), F.lit("")) != "deleted").drop("status")


def status_report(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of added, updated and unchanged rows, in all or per group."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "unchanged")]
    return diff.groupBy(*(by or [])).agg(*counts)
