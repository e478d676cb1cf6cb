"""runlens: a Spark-native engine for developer-tool output and text corpora."""
