"""attestry: a PySpark engine for document evidence, retrieval and profile fusion."""
