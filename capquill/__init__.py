"""Packet-capture analytics on Spark DataFrames."""
