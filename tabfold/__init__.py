"""tabfold: supervised-classification experiments on Spark DataFrames.

Layout
------
sources/    delimited scans (headerless, compressed, multi-row header,
            positional), small local tables, sinks and model persistence
functions/  Column-expression helpers (labels, name families, hash units)
operators/  DataFrame -> DataFrame operators: wrangling, profiling,
            splits and folds, feature transformers, reduction, learners,
            evaluation, importance
plans/      composed experiments (variants, seed sweeps, cross-validation),
            end-to-end jobs and the registered query catalog
streaming/  scoring of fitted pipelines over streaming DataFrames
"""

__version__ = "0.1.0"
