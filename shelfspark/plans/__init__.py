"""Query wiring: the registered queries and their SQL oracle texts."""
