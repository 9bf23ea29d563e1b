"""Scan, cube build and query, histograms and rendering."""
