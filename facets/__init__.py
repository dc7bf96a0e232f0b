"""Segment large tables of dated, rated text records with Spark DataFrames."""
