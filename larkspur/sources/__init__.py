"""Sources and sinks: list documents, board snapshots, structured pages, content-addressed tables."""
