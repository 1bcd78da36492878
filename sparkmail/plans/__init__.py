"""Registered queries: mail-shaped views of the test tables, and the check SQL."""
