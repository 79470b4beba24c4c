"""Registered queries over the star schema, each with the SQL it must agree with."""
