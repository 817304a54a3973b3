"""Spark jobs over catalogues of described media, as DataFrame-to-DataFrame functions."""
