"""lodestack: retrieval analytics as Spark queries over whole tables."""
