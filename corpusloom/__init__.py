"""corpusloom: corpus preparation, retrieval and scoring as Spark DataFrame transforms."""
