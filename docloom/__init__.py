"""Documentation corpora on Spark: crawled pages in, searchable Markdown bundles out."""
