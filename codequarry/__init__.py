"""Code-base analytics and corpus preparation on Apache Spark."""
