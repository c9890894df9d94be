"""Record, set, graph and trace operators: DataFrame in, DataFrame out, nothing collected."""
