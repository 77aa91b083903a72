"""Sources and sinks: tick files, day index, daily aggregates, lookup tables, fixtures."""
