"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ in ("NaTType", "NAType"):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(value(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark_df, duck_df):
    a, b = spark_df.toPandas(), duck_df.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
