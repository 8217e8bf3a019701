"""Market-panel analytics as DataFrame-to-DataFrame operators for Spark."""
