"""Tillage: preparing tables and image sets for machine learning, as Spark DataFrame operators."""
