"""Quota-panel survey analytics as compositions of Spark DataFrame operators."""
