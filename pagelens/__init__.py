"""pagelens: sort web pages into configurable categories with Spark.

Every operator takes and returns DataFrames or Columns. See README.md for a
tour and ``__spark_entry__.py`` for one runnable query per operator.
"""

__version__ = "0.1.0"
