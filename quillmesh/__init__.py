"""quillmesh: a Spark-native engine for service-intake envelopes."""
