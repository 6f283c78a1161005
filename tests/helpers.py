"""Small hand-made logs."""

from datetime import datetime, timedelta

from pixeltide.sources.schema import CLEAN

T0 = datetime(2022, 4, 1, 12)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def make_log(spark, rows):
    """Rows of (user, seconds after T0 or None, colour, x, y)."""
    data = [(None if s is None else at(s), user, color, x, y) for user, s, color, x, y in rows]
    return spark.createDataFrame(data, CLEAN)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def final_plan(df):
    """The physical plan after adaptive execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
