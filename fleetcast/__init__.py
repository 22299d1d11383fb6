"""fleetcast: fleet demand and booking analytics on Spark (see README.md)."""

__version__ = "0.1.0"
