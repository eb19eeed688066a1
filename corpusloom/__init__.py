"""A document-corpus engine on PySpark: sources, checks, chunking, vector search, graph walks, audits and lifecycle state."""
