"""Scalar expressions: matrices, bounding volumes, geodesy, screen-space error, URIs and content markers."""
