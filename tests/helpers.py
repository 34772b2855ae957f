from pyspark.sql import functions as F


def values(spark, column, inputs, kind="string"):
    """Results of a Column function of `x` over inputs, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
