"""Table-level operators: DataFrame in, DataFrame out, nothing executed."""
