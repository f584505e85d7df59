"""Quasi-experimental policy evaluation on PySpark.

Every public operator takes DataFrames and column names and returns a DataFrame (or a small fitted
object holding coefficients). Row-level work is declared with the DataFrame API; only statistics whose
size does not depend on the number of rows reach the driver.
"""

__version__ = "0.1.0"
