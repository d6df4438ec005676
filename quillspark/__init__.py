"""quillspark: a Spark-native engine for text-workflow and training-data pipelines."""
