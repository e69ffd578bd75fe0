"""Registered queries of the traffic operators, and the SQL that states their results."""
