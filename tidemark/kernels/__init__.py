"""Numeric kernels over one series in numpy: what needs sequential state or dense transforms."""
