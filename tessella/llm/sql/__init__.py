"""DuckDB SQL that gives the same rows as the queries."""
