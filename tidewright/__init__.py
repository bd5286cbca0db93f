"""Sensor-observation analytics on Spark: alignment, quality flags, spectra, splits and scores."""
