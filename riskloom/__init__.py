"""Spatio-temporal risk grids on Spark DataFrames.

Incidents become a dense area x time panel with labels and leak-free priors;
the panel is rolled up, used to train classifiers and turned into ranked
forecasts.  Every operator takes and returns a DataFrame (or a Column), so it
can be used alone or chained with ``DataFrame.transform``.
"""
