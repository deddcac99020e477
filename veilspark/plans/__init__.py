"""The engine, the query catalogue and its SQL."""
