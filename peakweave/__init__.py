"""Spark operators for mass-spectrometry peak and feature tables."""
