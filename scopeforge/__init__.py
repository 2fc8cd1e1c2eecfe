"""scopeforge: a Spark-native index of code symbol occurrences.

Symbols (definitions and usages with a lexical scope path) are rows of a DataFrame;
every search answers a whole table of probes in one job with joins, windows and
aggregations.  See README.md for the module map.
"""

__version__ = "0.1.0"
