"""Analytics over agent-memory data as Spark DataFrame transformations."""
