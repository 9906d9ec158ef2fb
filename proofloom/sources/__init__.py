"""Readers and writers for the file shapes the operators start from and end in."""
