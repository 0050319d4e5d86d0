"""Registered queries over the driver tables and the SQL they must agree with."""
