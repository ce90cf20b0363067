"""screenloom: screening of large labelled-entity tables as Spark DataFrame jobs."""

__version__ = "0.1.0"
