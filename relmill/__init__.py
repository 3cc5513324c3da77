"""relmill: document relation extraction jobs expressed as Spark DataFrame transforms."""
