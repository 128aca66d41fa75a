"""readloom: Spark-native analytics over sequencing alignments.

Every operator takes and returns DataFrames; nothing here runs an action
unless its docstring says so.
"""
