"""readloom: sequencing-read demultiplexing, trimming and auditing on Spark."""

__version__ = "0.1.0"
