"""tessella: rule mining, ranking and audit analytics as Spark DataFrame plans."""
