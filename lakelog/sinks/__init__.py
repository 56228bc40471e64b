"""Writers: run-log tables, search results, log lines, audit results."""
