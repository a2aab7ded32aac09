"""Site-graph and content analytics expressed as Spark DataFrame operators."""
