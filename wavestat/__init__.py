"""wavestat: survey-wave analytics as Spark DataFrame operators.

Layout:
  sources/    readers and writers (driver tables, waves, combined table, sinks)
  functions/  column-expression helpers (recodes, dummies, bins, formatting)
  operators/  DataFrame -> DataFrame operators (harmonise, shares, estimators)
  plans/      the study's products, the query catalog and the oracle SQL
  streaming/  the harmonise projection applied to a stream of wave files
"""

__version__ = "0.1.0"
