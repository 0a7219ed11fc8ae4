"""Evidence-retrieval analytics engine on PySpark."""
