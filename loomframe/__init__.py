"""Labelled frames, series and arrays as lazy Spark plans."""
