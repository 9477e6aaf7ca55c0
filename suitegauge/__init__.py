"""suitegauge: Spark jobs that judge generated test suites.

Operators take and return DataFrames; nothing here collects data to the driver.
"""
