"""tessera: explainable sparse retrieval and text-corpus analytics as Spark jobs."""
