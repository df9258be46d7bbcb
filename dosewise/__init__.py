"""Contrast-direction and dose-response analytics as PySpark DataFrame operators."""
