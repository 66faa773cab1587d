"""Composed jobs, views over the supplied tables and the catalogue of registered queries."""
