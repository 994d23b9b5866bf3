"""inkwell: a Spark-native engine for document collections and the rules that govern them."""
