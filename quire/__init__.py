"""Document analytics on Spark: ordered tables of paragraphs, runs, cells, pages and characters."""
