"""scrinium: document search and retrieval analytics as Spark plans."""
