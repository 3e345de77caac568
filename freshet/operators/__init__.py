"""DataFrame operators. Unless stated otherwise a table holds one row per series and date."""
