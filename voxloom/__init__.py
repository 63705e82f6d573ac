"""Voxloom: volumes, voxel series and feature stacks as Spark DataFrames."""

__version__ = "0.1.0"
