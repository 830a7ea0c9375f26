"""arcloom: labelled property graphs and graph queries on Spark DataFrames."""

__version__ = "0.1.0"
