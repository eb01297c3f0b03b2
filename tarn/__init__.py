"""Tarn: financial-crime analytics as DataFrame-to-DataFrame operators on Spark."""
