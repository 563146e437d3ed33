"""SQL text: tokens and the dialect's rewriting into Spark SQL."""
