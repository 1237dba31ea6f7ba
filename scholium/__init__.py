"""A Spark-native engine for course-material corpora, retrieval and learner activity."""
