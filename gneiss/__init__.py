"""Gneiss: analytics over versioned architecture graphs, written for PySpark."""
