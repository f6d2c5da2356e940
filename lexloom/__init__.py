"""lexloom: retrieval analytics over legal-style text, written as Spark jobs."""
