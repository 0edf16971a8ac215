"""diglot: a Spark-native engine for bilingual documents and text corpora."""
