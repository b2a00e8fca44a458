"""tillage: Spark-native operators for profiling, modelling and scoring measurement tables.

Sub-packages
------------
sources    readers / writers (CSV with missing-value markers, JSON params, model artefacts,
           file index, partitioned outputs, the driver's test tables)
functions  column-expression builders (target conditioning, text checks, scalar helpers)
operators  DataFrame -> DataFrame operators (profiling, metrics, folds, features, ranking, joins)
plans      multi-job plans (model comparison, quantile boosting, permutation importance,
           per-group models, classification, batch scoring, text generation)
streaming  row-wise operators wired onto Structured Streaming sources
"""

__version__ = "0.1.0"
