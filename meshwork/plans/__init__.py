"""Named queries with the SQL that states them."""
