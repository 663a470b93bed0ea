"""Cleaning, profiling, scanning and inspection over DataFrames."""
