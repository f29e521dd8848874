"""docjobs: Spark jobs over tables of documents."""
