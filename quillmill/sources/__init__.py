"""Scans of image folders and stored tables."""
