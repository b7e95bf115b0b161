"""Quadrille: tiled level-of-detail 3D datasets and large tables as Spark DataFrames."""
