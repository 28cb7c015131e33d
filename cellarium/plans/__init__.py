"""Named queries over derived tables, and the SQL they must equal."""
