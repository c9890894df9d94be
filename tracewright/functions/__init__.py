"""Access traces, statistics and scalar functions."""
