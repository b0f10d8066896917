"""Chat-message analytics on PySpark: pure, deterministic DataFrame -> DataFrame functions."""
