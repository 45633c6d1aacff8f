"""Named queries over the supplied tables, and the registry that collects them."""
