"""lexiloom: analytics over large collections of byte strings on Spark SQL."""
