"""Query plans and the staging helpers they share."""
