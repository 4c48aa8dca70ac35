"""Readers, writers and the table views the queries start from."""
