"""Plan-level building blocks: fixture views over the test tables, the
skew-safe ordered scan (dense positions and running sums), job templates."""
