"""ruleloom: rule reasoning over triples, written as Spark DataFrame plans."""
