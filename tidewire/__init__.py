"""tidewire: news and event analytics as Spark DataFrame jobs."""
