"""DataFrame -> DataFrame operators: chunking, cleaning, layout, retrieval, extraction, review, operations."""
