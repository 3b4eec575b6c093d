"""Trainers of factor models over DataFrames."""
