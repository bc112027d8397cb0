"""Named queries over the generated tables, by subject."""
