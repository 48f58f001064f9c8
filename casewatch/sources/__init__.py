"""Case files, catalog tables and the benchmark views."""
