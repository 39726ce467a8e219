from pyspark.sql import functions as F


def col_values(spark, values, fn, dtype="string"):
    """Apply a Column function to a list of values, keeping order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def responses_df(spark, rows, schema="model string, value int, item_id long, rating_text string"):
    return spark.createDataFrame(rows, schema)


def key_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, question string, trait string, weight double")
