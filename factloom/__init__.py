"""factloom: a Spark-native engine for cataloguing items by confidence-carrying facts."""
