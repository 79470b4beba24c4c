"""Graph-pattern analytics and data-processing operators on Spark DataFrames."""
