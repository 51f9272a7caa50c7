"""Sources and sinks: adapters, recordings, synthetic cohorts, files."""
