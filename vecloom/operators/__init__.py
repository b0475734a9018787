"""Operators over vector DataFrames: exact search, clustering, quantization, estimation, evaluation."""
