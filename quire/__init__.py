"""quire: a Spark-native engine for books and other long documents."""
