"""Braidwork: knowledge-graph integration and similarity analytics as Spark plans."""
