"""Rollups that run alike over tables and streams."""
