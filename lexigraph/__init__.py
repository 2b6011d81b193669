"""Full-text search and corpus analytics as Spark DataFrame plans."""
