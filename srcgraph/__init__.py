"""srcgraph: structural questions about source code as Spark queries."""
