"""Relations between tables, found in their data.

Each distinct value has the set of columns that hold it. Sets that are equal are counted together, and a pair of
columns shares as many values as the sets with both have. A first pass does this for one value of 64, drawn by a
hash that is the same for all columns, so that a share of common values shows in the sample as it is in the whole; the
pairs that it leaves, few as a rule, are counted exactly in a second pass over their columns alone. A column with few
values in the sample is never ruled out by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.checkpoints import cut

#: One of so many values is in the sample; with fewer values there a column is counted in whole; the share of a pair that the sample may show for one of the least share wanted.
DRAWN, FEW, SLACK = 64, 40, 0.8


def kind(data_type: T.DataType) -> str | None:
    """Types that meet: whole numbers, texts, and dates; others are no keys."""
    kinds = {"number": (T.IntegralType,), "text": (T.StringType,), "date": (T.DateType,)}
    return next((k for k, types in kinds.items() if isinstance(data_type, types)), None)


def names(table: str, column: str) -> set[str]:
    """What a column may be called elsewhere: its own name, that without a prefix of one letter, and that behind its table's name."""
    head, _, rest = column.partition("_")
    return {column, f"{table.removesuffix('s')}_{column}"} | ({rest} if rest and len(head) == 1 else set())


def held_values(tables: dict[str, DataFrame], columns: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, value, column, rows) of the columns, which go by their number. Each table is read once."""
    out = None
    for name, df in tables.items():
        own = [F.struct(F.lit(k).alias("column"), F.lit(of).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for k, (t, c, of) in enumerate(columns) if t == name]
        if own:
            one = df.select(F.inline(F.array(*own))).where("value IS NOT NULL")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("kind", "value", "column").agg(F.count("*").alias("rows"))


def shared(values: DataFrame) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]]]:
    """Distinct values that two columns share, and of each column its distinct values and rows. As many rows as there are pairs of columns reach the driver."""
    sets = values.groupBy("kind", "value").agg(F.sort_array(F.collect_set("column")).alias("set")).groupBy("set").agg(F.count("*").alias("n"))  # of the columns
    pairs = sets.select("n", F.explode("set").alias("child"), "set").select("n", "child", F.explode("set").alias("parent")).groupBy("child", "parent").agg(F.sum("n").alias("n"))
    totals = values.groupBy("column").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return {(r["child"], r["parent"]): r["n"] for r in pairs.collect()}, {r["column"]: (r["n"], r["rows"]) for r in totals.collect()}


def suggest(tables: dict[str, DataFrame], least: float = 0.95, *, by_name: bool = True) -> list[tuple[str, str, str, str, int, float]]:
    """(table, column, other table, key, distinct values, share of them that are keys there), the greatest share first.

    A key has another value in every row of its table. by_name: one of the names that a column may have is one of the other's.
    """
    columns = [(t, f.name, k) for t, df in tables.items() for f in df.schema.fields if (k := kind(f.dataType))]
    rows = {t: df.count() for t, df in tables.items()}

    def may_be(child: int, parent: int) -> bool:
        (t, c, of), (u, d, other) = columns[child], columns[parent]
        return t != u and of == other and (not by_name or bool(names(t, c) & names(u, d)))

    drawn = held_values(tables, columns).where(F.pmod(F.xxhash64("kind", "value"), F.lit(DRAWN)) == 0)
    common, totals = shared(cut(drawn))
    few = {k for k in range(len(columns)) if totals.get(k, (0, 0))[0] < FEW}
    unique = {k for k in range(len(columns)) if k in few or totals[k][0] == totals[k][1]}  # a value that comes again is no key's
    left = {
        (child, parent) for child in range(len(columns)) for parent in unique
        if may_be(child, parent) and (child in few or common.get((child, parent), 0) >= SLACK * least * totals[child][0])
    }
    if not left:
        return []
    chosen = sorted({k for pair in left for k in pair})
    common, totals = shared(cut(held_values(tables, [columns[k] for k in chosen])))
    at, out = {k: n for n, k in enumerate(chosen)}, []
    for child, parent in left:
        n, (distinct, filled) = totals.get(at[child], (0, 0))[0], totals.get(at[parent], (0, 0))
        both = common.get((at[child], at[parent]), 0)
        if n and distinct == filled == rows[columns[parent][0]] and both >= least * n:
            out.append((*columns[child][:2], *columns[parent][:2], n, both / n))
    return sorted(out, key=lambda x: (-x[5], x))
