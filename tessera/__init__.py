"""Tessera: corpus analytics on Spark.

Source trees and text tables become DataFrames; extraction, pattern search, coverage
joins, rollups and edits are DataFrame pipelines over them.
"""
