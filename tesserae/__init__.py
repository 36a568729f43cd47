"""Evidence analytics and corpus preparation as declarative Spark jobs."""
