"""quillspark: document analytics and hybrid retrieval as lazy Spark DataFrame operators."""
