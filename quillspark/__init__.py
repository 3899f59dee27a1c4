"""quillspark: Spark-first operators for auditing test suites and preparing training text."""
