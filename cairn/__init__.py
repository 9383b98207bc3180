"""Key-space analytics on Spark: collection operators, command-log folds, sources and streams."""
