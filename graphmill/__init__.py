"""graphmill: a PySpark-native engine for property-graph queries, search and telemetry analytics."""
