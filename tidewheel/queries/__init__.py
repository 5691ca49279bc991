"""Registered queries: each operator on bars made from the given tables, with independent DuckDB SQL."""
