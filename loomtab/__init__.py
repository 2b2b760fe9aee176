"""Cleaning and enriching delimited text on Spark."""
