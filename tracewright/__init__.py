"""A PySpark-native engine for agent-trajectory analytics."""
