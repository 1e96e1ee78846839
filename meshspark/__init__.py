"""Hexahedral meshes as DataFrames: generation, formats, topology, quality and partitioning on Spark."""
