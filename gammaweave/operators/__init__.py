"""Operators on rays, images and sparse matrices."""
