"""pagemill: a Spark-native engine over a content-addressed index of code pages.

Tables go in as DataFrames, every operator is a function from DataFrames to a
DataFrame, and Catalyst plans the rest.
"""
