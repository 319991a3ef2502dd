"""cytofold: analytics over sparse observation x feature count matrices, planned by Spark."""

__version__ = "0.1.0"
