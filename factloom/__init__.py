"""Claim analytics on Spark."""
