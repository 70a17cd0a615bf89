"""quillcheck: rule checking of document collections on Spark DataFrames."""
