"""mendweave: a PySpark engine that finds replacement pages for dead links and curates text corpora."""
