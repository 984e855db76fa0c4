"""Sources and sinks: message tables (JDBC or Parquet), split files, run
configs, the metrics table, and the fixture views over the driver tables."""
