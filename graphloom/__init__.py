"""graphloom: labelled-graph, sequence and sparse-vector analytics expressed as Spark plans."""

__version__ = "0.1.0"
