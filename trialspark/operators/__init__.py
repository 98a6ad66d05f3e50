"""Table operators: DataFrame in, DataFrame out, for one or many experiments."""
