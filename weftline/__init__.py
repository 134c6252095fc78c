"""weftline: files, documents and media timelines as Spark tables."""
