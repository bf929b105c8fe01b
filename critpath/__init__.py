"""Multi-criteria shortest-path analytics and corpus preparation on Spark."""
