"""Scalar functions as native SQL expressions."""
