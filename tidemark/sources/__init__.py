"""Readers and writers of sampled signals, event grids and tables."""
