"""Sources and sinks: test tables, CSV impression logs, Parquet / JSON sinks,
Kafka-shaped request streams."""
