"""Named queries over the data tables, each with the SQL that checks it."""
