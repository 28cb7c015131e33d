"""Table operators: covers, key ranges, lookups and routes."""
