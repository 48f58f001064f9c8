"""Plan building blocks: size checks, hot-key splitting, ranking, lineage."""
