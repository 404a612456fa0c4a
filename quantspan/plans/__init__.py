"""Plan shapes shared by the operators: positions, blocks, as-of, interval join, ordered fold."""
