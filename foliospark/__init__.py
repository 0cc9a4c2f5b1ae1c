"""foliospark: document intelligence and job analytics as Spark DataFrame operators."""
