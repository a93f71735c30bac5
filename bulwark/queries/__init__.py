"""Queries over the driver's tables, one or more per operator, each with DuckDB SQL where SQL expresses it."""
