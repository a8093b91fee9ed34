"""strandframe: interval, sequence, ranking and evaluation queries on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame.  Nothing runs on
the driver unless the docstring says so and names the bound on what it holds.
"""

__version__ = "0.1.0"
