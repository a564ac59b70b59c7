"""Sequencing-read quantification on graph-shaped genomes, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
