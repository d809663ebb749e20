"""A Spark-native engine for profiling, cleaning, describing, testing and modelling tables."""
