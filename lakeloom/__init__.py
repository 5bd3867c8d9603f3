"""lakeloom: reporting, graph, text and retrieval operators as Spark DataFrame jobs."""
