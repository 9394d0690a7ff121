"""Scalar functions: residue codes and similarities, pair scores, special functions."""
