"""ticklens: market-microstructure analytics for trade and quote ticks on Spark.

Layers (each takes and returns DataFrames; nothing is collected to the driver):

* ``sources``   - tick file scans, day index, aggregate sinks, lookup tables, test adapters
* ``functions`` - column expressions: conversions, time rounding, special functions, OLS
* ``operators`` - cleaning, sequence windows, daily aggregates, sampled series,
                  intervals, container, regressions, comparisons, distribution checks
* ``plans``     - end-to-end jobs and the catalogue of named queries
"""

__version__ = "0.1.0"
