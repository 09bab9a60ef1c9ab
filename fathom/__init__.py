"""fathom: retrieval and analytics over document collections, written as Spark jobs."""
