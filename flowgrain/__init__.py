"""Source-flow analytics on Spark: code, call graphs and flowcharts as DataFrames."""

__version__ = "0.1.0"
