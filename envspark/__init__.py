"""envspark: environmental-monitoring analytics on Spark DataFrames.

Column functions live in :mod:`envspark.functions`, DataFrame operators in
:mod:`envspark.operators`, readers and writers in :mod:`envspark.sources`,
incremental top-up in :mod:`envspark.streaming` and the composed queries in
:mod:`envspark.plans`.
"""
