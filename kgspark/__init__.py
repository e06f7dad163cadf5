"""PySpark operators for building and querying a knowledge graph from work documents."""
