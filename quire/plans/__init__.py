"""Plans of work as tables: job matrices, sweeps, leaderboards."""
