"""Chat-history analytics as plain PySpark DataFrame functions."""
