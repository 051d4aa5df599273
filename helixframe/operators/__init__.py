"""DataFrame operators: interval and co-located joins, picks, comparison of outputs."""
