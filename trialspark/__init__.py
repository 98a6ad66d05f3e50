"""Experiment analysis on Spark DataFrames."""

CONTROL = "control"
TREATMENT = "treatment"
