"""Spark jobs for multi-modal field-observation data."""
