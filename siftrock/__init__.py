"""siftrock: rule-based corpus and source-code analysis expressed as Spark DataFrame jobs."""
