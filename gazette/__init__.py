"""Listing and directory analytics on Spark."""
