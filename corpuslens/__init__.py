"""Evidence retrieval and classifier evaluation over document corpora, as Spark jobs."""
