"""Readers and writers for cell, vector, inventory and run-log tables."""
