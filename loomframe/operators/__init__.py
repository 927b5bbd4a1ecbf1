"""Frames, series, groups, joins, reshaping, windows, resampling, labels and arrays."""
