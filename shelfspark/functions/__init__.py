"""Column-level helpers: text, dates, ordering and paging."""
