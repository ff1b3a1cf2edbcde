"""codeseam: code search, relation graphs and corpus processing as Spark DataFrame plans."""
