"""Collections of documents as tables on Spark: structure, size, links and Markdown trees."""
