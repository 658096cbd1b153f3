"""Analytics of field observations on Spark: DataFrame in, DataFrame out."""
