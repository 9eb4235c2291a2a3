"""Streams of observations into the database."""
