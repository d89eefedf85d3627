"""speechtab: a PySpark-native engine for speech transcripts and other noisy text."""
