"""quire: analytics over laid-out, bilingual publications as Spark DataFrames."""
