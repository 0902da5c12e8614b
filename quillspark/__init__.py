"""quillspark: document search and corpus maintenance as Spark DataFrame plans."""
