"""Plans: running checks, reports and the query catalogue."""
