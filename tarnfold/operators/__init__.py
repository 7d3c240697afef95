"""Operators on DataFrames; each is a function of frames and parameters and plans nothing eagerly unless it iterates."""
