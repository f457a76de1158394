"""Registered queries, each next to the SQL it must agree with."""
