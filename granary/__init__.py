"""Frequent-itemset mining on Spark DataFrames."""
