"""flowframe: data-flow pipelines expressed as Spark DataFrame plans."""
