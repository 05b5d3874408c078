"""Small frames for table-driven tests."""


def one_col(spark, values, ddl="x string"):
    """DataFrame with one row per value (keeps input order in an ``i`` column)."""
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, " + ddl)


def collect_ordered(df, col):
    return [r[col] for r in df.orderBy("i").collect()]
