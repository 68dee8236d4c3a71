"""codelode: code retrieval, symbol graphs and data checks over many repositories, as Spark plans."""
