"""Compositions of operators: registered queries, reports and the service facade."""
