"""Change batches: row hashes, differences of two states, merges, and the current state of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .topn import latest


def row_hash(columns: list[str]) -> Column:
    """64-bit hash of the non-null name=value pairs, in order of the names."""
    parts = [F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in sorted(columns)]
    return F.xxhash64(F.concat_ws("\x1f", *parts))


def keyed_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """after's and before's rows that differ, with _op insert, update or delete. A deleted row shows its old values."""
    values = [c for c in after.columns if c not in key]
    pack = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in key), F.struct(*values).alias(name))
    same_key = [F.col(f"b_{k}").eqNullSafe(F.col(f"a_{k}")) for k in key]
    both = pack(before, "b").join(pack(after, "a"), same_key, "full")
    op = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.withColumn("_op", op).where("_op IS NOT NULL").select("_op", *(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key), *(F.when(F.col("a").isNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values))


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that a keyless table lost or gained, with _op and _n, how many times. One aggregate over both."""
    columns = after.columns
    both = after.withColumn("_d", F.lit(1)).unionByName(before.withColumn("_d", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_d").alias("_n")).where("_n != 0").withColumn("_op", F.when(F.col("_n") > 0, "insert").otherwise("delete")).withColumn("_n", F.abs("_n"))


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target with source's rows in place of those of the same key, and the new ones added. A null key is a key like
    others; of a key that source repeats, the greatest row by its other columns stays."""
    rest = [c for c in source.columns if c not in key]
    once = source.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest)) if rest else source.distinct()
    keys = once.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return target.join(keys, same, "left_anti").unionByName(once.select(*source.columns))


def accumulate(target: DataFrame, batch: DataFrame, key: list[str], sums: list[str], latest_of: list[str] = ()) -> DataFrame:
    """Running totals: sums are added, latest_of take the greater, keys that are new begin."""
    how = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in latest_of]
    return target.unionByName(batch).groupBy(*key).agg(*how)


def current_state(log: DataFrame, key: list[str], order: list[str], op: str = "_op") -> DataFrame:
    """Last version of each key of a change log, without the deleted. At the same order an insert or update beats a delete."""
    ranked = log.withColumn("_live", (F.col(op) != "delete").cast("int"))
    return latest(ranked, key, [*order, "_live"]).where(F.col(op) != "delete").drop("_live", op)


def after_watermark(source: DataFrame, column: str, mark, lookback=None) -> DataFrame:
    """Rows beyond the watermark less the lookback; the filter reaches the scan."""
    bound = F.lit(mark) if lookback is None else F.lit(mark) - lookback
    return source.where(F.col(column) > bound)


def unseen(rows: DataFrame, keys_state: DataFrame, key: list[str]) -> DataFrame:
    """Rows of which no row with the same key and hash is in the key state (key columns and _hash)."""
    values = [c for c in rows.columns if c not in key]
    return rows.withColumn("_hash", row_hash(values)).join(keys_state, [*key, "_hash"], "left_anti").select(rows.columns)


def soft_deletes(rows: DataFrame, flag: str) -> DataFrame:
    """rows with _op: delete where the flag is true, not zero, or set at all if it is neither."""
    kind = rows.schema[flag].dataType
    set_ = F.col(flag) if isinstance(kind, T.BooleanType) else F.col(flag) != 0 if isinstance(kind, T.NumericType) else F.col(flag).isNotNull()
    return rows.withColumn("_op", F.when(F.coalesce(set_, F.lit(False)), "delete").otherwise("upsert"))


WIDER = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp")}


def schema_diff(before: T.StructType, after: T.StructType) -> list[tuple[str, str, bool]]:
    """(column, added / removed / widened / narrowed, whether it breaks readers)."""
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (before, after))
    out = [(c, "added", False) for c in new if c not in old] + [(c, "removed", True) for c in old if c not in new]
    for c in old.keys() & new.keys():
        if old[c] != new[c]:
            wide = (old[c], new[c]) in WIDER
            out.append((c, "widened" if wide else "narrowed", not wide))
    return sorted(out)


def scd2_start(rows: DataFrame, since: str) -> DataFrame:
    """First versions: valid from a column's time, open ended."""
    return rows.withColumns({"valid_from": F.col(since), "valid_to": F.lit(None).cast(rows.schema[since].dataType), "is_current": F.lit(True)})


def scd2_apply(history: DataFrame, changes: DataFrame, key: list[str], tracked: list[str], ts: str) -> DataFrame:
    """history with the versions closed whose tracked columns change, and the new versions opened."""
    new = changes.select(*key, *(F.col(c).alias(f"_{c}") for c in tracked), F.col(ts).alias("_ts"))
    current = history.where("is_current").join(new, key, "full")
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    moved = F.col("_ts").isNotNull() & (F.col("is_current").isNull() | differs)
    old = current.where("is_current IS NOT NULL").withColumns({"valid_to": F.when(moved, F.col("_ts")).otherwise(F.col("valid_to")), "is_current": ~moved}).select(history.columns)
    opened = current.where(moved).select(*(F.col(c) for c in key), *(F.col(f"_{c}").alias(c) for c in tracked), F.col("_ts").alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"), F.lit(True).alias("is_current"))
    return history.where("NOT is_current").unionByName(old).unionByName(opened, allowMissingColumns=True)


def at_time(facts: DataFrame, history: DataFrame, key: list[str], ts: str, how: str = "left") -> DataFrame:
    """facts with the version of history that was valid at their time: an equi-join on the key with a range on top."""
    h = history.select(*(F.col(k).alias(f"_h_{k}") for k in key), *(c for c in history.columns if c not in key))
    on = [F.col(k) == F.col(f"_h_{k}") for k in key] + [F.col("valid_from") <= F.col(ts), F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to"))]
    return facts.join(h, on, how).drop(*(f"_h_{k}" for k in key))


