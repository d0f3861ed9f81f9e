"""Ready-made queries over the benchmark tables and their check SQL."""
