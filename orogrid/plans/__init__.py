"""Query plans over the given tables, with the DuckDB SQL that each must equal."""
