"""Training-data operators for corpora (documents, pages, benchmark tables)."""
