"""Frames: missing values, the long and pair-long layouts, group statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rank error of the sketch that brackets a group's median, as one over this part of its rows.
SKETCH = 10_000
#: Up to so many groups, their statistics are sent to every task.
FEW_GROUPS = 5_000
#: Stands for "one group" where no keys are given.
ALL = "__all"


def finite(x: Column) -> Column:
    """NaN and infinities are null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _finite_columns(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"{c} is {kind.simpleString()}; only numeric columns can be used")
    return [finite(F.col(c)).alias(c) for c in columns]


def numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` as it is and ``columns`` as doubles with nulls for what is not finite; other types are refused."""
    return df.select(*keep, *_finite_columns(df, columns))


def complete(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``numeric`` without the rows that have a null, for columns that are costly to work out.

    A filter pushed below a projection holds a copy of an expression for every
    mention of its column and works each out again.  None passes a generator,
    so here every column is worked out once a row.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*_finite_columns(df, columns))))).dropna()


def long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, feature, value), nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs)).where("value is not null")


def pair_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """(keep…, f1, f2, x, y) for f1 before f2 (or all ordered pairs) where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if (i != j if ordered else i < j)]
    cells = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    return df.select(*keep, F.inline(cells)).where("x is not null and y is not null")


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame and its grouping keys; without keys, one constant key."""
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(1)), [ALL])


def attach(df: DataFrame, by: Sequence[str], *statistics: Column) -> DataFrame:
    """Every row with statistics of its group (null keys are a group).

    Statistics are aggregated first and then met by an equi-join, so a group is
    never held by one task; small parameter tables are broadcast by their size.
    """
    return meet(df, df.groupBy(*by).agg(*statistics), by)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; the right side's other columns are added."""
    more = [c for c in right.columns if c not in keys]
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *more)
    return left.join(named, [left[k].eqNullSafe(named[f"__{k}"]) for k in keys], how).select(*[left[c] for c in left.columns], *more)


def median_by(df: DataFrame, by: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    """(by…, name): the exact median of ``value`` in each group, nulls left out (groups without a value do not appear).

    A sketch of each group brackets its middle ranks.  What lies below and above
    the bracket is only counted, by partial aggregates; what lies inside is
    counted by value, and these counts (of about a 2,500th of a group's rows,
    equal values in one) are all that one task sees of a group.
    """
    rows = df.select(*by, value.alias("__v")).where("__v is not null")
    bracket = F.percentile_approx("__v", [0.5 - 2 / SKETCH, 0.5 + 2 / SKETCH], SKETCH)
    at = meet(rows, few(rows.groupBy(*by).agg(bracket.alias("__ends"), F.count(F.lit(1)).alias("__n"))), by)
    v, part = F.col("__v"), F.col("__part")
    at = at.withColumn("__part", F.when(v < F.col("__ends")[0], 0).when(v > F.col("__ends")[1], 2).otherwise(1))
    steps = at.groupBy(*by, "__n", "__part", F.when(part == 1, v).alias("__at")).agg(F.count(F.lit(1)).alias("__c"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    upto = Window.partitionBy(*by).orderBy("__part", "__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("__run", F.sum("__c").over(upto))
    run, before = F.col("__run"), F.col("__run") - F.col("__c")

    def ranked(r: Column) -> Column:
        # the values next to the bracket are known too
        found = F.when(part == 1, F.col("__at")).when((part == 0) & (r == run), F.col("__high")).when((part == 2) & (r == before + 1), F.col("__low"))
        return F.max(F.when((before < r) & (r <= run), found))

    n = F.col("__n")
    middle = steps.groupBy(*by).agg(ranked(F.floor((n + 1) / 2)).alias("__x"), ranked(F.floor(n / 2) + 1).alias("__y"))
    x, y = F.col("__x"), F.col("__y")
    # the sketch promises its error, but the promise is checked
    missed = F.raise_error(F.lit("a median lies outside its bracket")).cast("double")
    return middle.select(*by, F.when(x.isNull() | y.isNull(), missed).otherwise((x + y) / 2).alias(name))


def few(statistics: DataFrame) -> DataFrame:
    """Statistics of groups, worked out now and sent to every task where they are at most FEW_GROUPS; else as they are.

    So rows meet them where they lie: no task gathers or sorts the rows of a large group. Only the plan depends on the number.
    """
    found = statistics.limit(FEW_GROUPS + 1).collect()
    return F.broadcast(statistics.sparkSession.createDataFrame(found, statistics.schema)) if len(found) <= FEW_GROUPS else statistics
