"""A PySpark-native engine for dense subgraphs: triangles, cores, trusses, partitions and labelled patterns."""
