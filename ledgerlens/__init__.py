"""Listing-integrity analytics and corpus preparation, written as Spark DataFrame programs."""
