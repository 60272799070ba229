"""brookhouse: a real-time e-commerce warehouse written as Spark DataFrame jobs."""
