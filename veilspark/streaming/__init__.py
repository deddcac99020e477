"""Keyed state: handles with a time to live, session counters."""
