"""Registered queries over the provided tables, with DuckDB SQL."""
