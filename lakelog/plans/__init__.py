"""Named queries over the given tables, the inputs they derive from them, and the SQL that checks them."""
