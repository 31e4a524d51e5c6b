"""Readers and writers; every reader returns raw rows with a ``row_pos``."""
