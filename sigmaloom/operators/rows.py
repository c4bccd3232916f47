"""Rows and cells: missing tokens, finite numbers, column kinds, extraction, visibility, filters, paging."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running

#: Cells that mean missing, in upper case.
MISSING = ("", "*", "NA", "N/A", "NAN", "NULL")
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9a-fA-F]+)$"
#: Comparisons that a structured filter may use.
COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "LIKE": lambda c, v: c.like(v), "IS NULL": lambda c, v: c.isNull(), "IS NOT NULL": lambda c, v: c.isNotNull(),
}


def is_missing(cell: Column) -> Column:
    return cell.isNull() | F.upper(F.trim(cell)).isin(*MISSING)


def number(cell: Column) -> Column:
    """The cell as a finite double, else null. Decimal and hexadecimal integers and exponents; no suffixes."""
    text = F.trim(cell)
    plain = F.when(text.rlike(r"^[+-]?0[xX]"), F.conv(F.regexp_replace(text, r"^[+-]?0[xX]", ""), 16, 10).cast("double") * F.when(text.startswith("-"), -1).otherwise(1)).otherwise(text.try_cast("double"))
    return F.when(text.rlike(NUMBER) & (F.abs(plain) < float("inf")), plain)


def cell_state(cell: Column) -> Column:
    """valid, missing or invalid, for a cell of a numeric column."""
    return F.when(is_missing(cell), "missing").when(number(cell).isNull(), "invalid").otherwise("valid")


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per text column: column, kind, n_valid, n_missing, n_invalid.

    numeric: all cells that are not missing are numbers, or some are and not all look like times; time: all
    look like times; unknown: all missing; else categorical. One pass over the table.
    """
    def sums(c: str) -> Column:
        cell = F.col(c).cast("string")
        there, num = ~is_missing(cell), number(cell).isNotNull()
        return F.struct(
            F.lit(c).alias("column"), F.count_if(there).alias("n"), F.count_if(~there).alias("n_missing"),
            F.count_if(there & num).alias("n_number"), F.count_if(there & cell.rlike("[-/:Tt]")).alias("n_time"),
        )

    rows = df.agg(F.array(*[sums(c) for c in columns]).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    kind = (
        F.when(F.col("n") == 0, "unknown")
        .when((F.col("n_number") == F.col("n")) | ((F.col("n_number") > 0) & (F.col("n_time") < F.col("n"))), "numeric")
        .when(F.col("n_time") == F.col("n"), "time")
        .otherwise("categorical")
    )
    valid = F.when(F.col("kind") == "numeric", F.col("n_number")).otherwise(F.col("n"))
    return rows.withColumn("kind", kind).select("column", "kind", valid.alias("n_valid"), "n_missing", (F.col("n") - valid).alias("n_invalid"))


def extract_counts(df: DataFrame, column: str, excluded: Column | None = None) -> DataFrame:
    """Counts of a numeric column's cells: excluded first, then missing, invalid and used ones."""
    out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    state = cell_state(F.col(column).cast("string"))
    return df.agg(
        F.count_if(out).alias("n_excluded"), F.count_if(~out & (state == "missing")).alias("n_missing"),
        F.count_if(~out & (state == "invalid")).alias("n_invalid"), F.count_if(~out & (state == "valid")).alias("n_used"),
    )


def extract_number(df: DataFrame, column: str, excluded: Column | None = None) -> DataFrame:
    """df with `value`, the rows left whose cell is a number and not excluded."""
    out = F.coalesce(excluded, F.lit(False)) if excluded is not None else F.lit(False)
    return df.withColumn("value", number(F.col(column).cast("string"))).where(~out & F.col("value").isNotNull())


def visibility(df: DataFrame, hidden: Column, excluded: Column) -> DataFrame:
    hidden, excluded = F.coalesce(hidden, F.lit(False)), F.coalesce(excluded, F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(hidden).alias("n_hidden"), F.count_if(excluded).alias("n_excluded"),
        F.count_if(hidden & excluded).alias("n_both"), F.count_if(~hidden).alias("n_shown"), F.count_if(~excluded).alias("n_analysed"),
    )


def structured_filter(df: DataFrame, conditions: list[tuple]) -> DataFrame:
    """Rows that meet all of (column, operator, value); an operator outside COMPARE raises ValueError."""
    for c, op, *_ in conditions:
        if op not in COMPARE or c not in df.columns:
            raise ValueError(f"no such column or comparison: {c} {op}")
    return df.where(reduce(and_, [COMPARE[op](F.col(c), v[0] if v else None) for c, op, *v in conditions], F.lit(True)))


def worksheet_filter(df: DataFrame, anywhere: str = "", per_column: dict[str, str] | None = None) -> DataFrame:
    """Rows that hold `anywhere` in some column and each given text in its column, whatever the case."""
    holds = lambda c, t: F.contains(F.lower(F.col(c).cast("string")), F.lit(t.lower()))
    keep = [reduce(or_, [F.coalesce(holds(c, anywhere), F.lit(False)) for c in df.columns])] if anywhere else []
    return df.where(reduce(and_, keep + [holds(c, t) for c, t in (per_column or {}).items()], F.lit(True)))


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows by keys, strictly after the given key values."""
    rows = df
    if after is not None:
        if len(after) != len(keys):
            raise ValueError("a value for each key is needed")
        rows = df.where(reduce(or_, [reduce(and_, [F.col(k) == v for k, v in zip(keys[:i], after, strict=False)], F.lit(True)) & (F.col(keys[i]) > after[i]) for i in range(len(keys))]))
    return rows.orderBy(*keys).limit(size)


def worksheet_sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Numbers as numbers and before texts, texts whatever their case."""
    cell = F.col(column).cast("string")
    keys = [number(cell).isNull(), number(cell), F.lower(cell)]
    return df.orderBy(*[k if ascending else k.desc() for k in keys])


def sorted_places(df: DataFrame, column: str, key: str, ascending: bool = True) -> DataFrame:
    """df with each row's position, 1, 2 and so on, in the order of worksheet_sort, ties by key."""
    cell = F.col(column).cast("string")
    ranks = [number(cell).isNull(), number(cell), F.lower(cell)]
    return running(df, [], [*[k.asc() if ascending else k.desc() for k in ranks], key], {"position": F.lit(1)})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns], F.lit(True)))


def without_rows(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return df.join(rows.select(key), key, "left_anti")


def stack(df: DataFrame, ids: list[str], columns: list[str], name: str = "factor", value: str = "response") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def mid_ranks(df: DataFrame, column: str, by: list[str] | None = None, alias: str = "mid_rank") -> DataFrame:
    """df with average ranks of a column within by, through counts of its distinct values."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    ranks = running(counts, by, [column], {"_u": F.col("_c")}).withColumn(alias, F.col("_u") - (F.col("_c") - 1) / 2).drop("_c", "_u")
    return df.join(ranks, [*by, column])


def key_faults(df: DataFrame, key: str) -> DataFrame:
    """Validation of a table's row key: rows, rows without a key, and rows that repeat another's key."""
    keys = df.groupBy(key).agg(F.count("*").alias("_n"))
    return keys.agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("without_key"), F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("_n") - 1)), F.lit(0)).alias("repeated"))
