"""Registered queries over the test tables, each with its independent SQL oracle."""
