SMALL = "/root/testdata/sf0.001"


def read(spark, table, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
