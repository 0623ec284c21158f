"""rankloom: ranked-retrieval analytics as PySpark DataFrame plans."""
