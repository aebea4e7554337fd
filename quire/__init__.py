"""quire: a PySpark-native engine for querying and curating a bibliographic document corpus."""
