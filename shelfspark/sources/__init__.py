"""Sources (table loads, fixture views) and sinks (report and snapshot writers)."""
