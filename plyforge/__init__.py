"""plyforge: paired-match evidence, position mining and corpus operators on Spark DataFrames."""
