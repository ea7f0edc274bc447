"""Sources and sinks: text lines, suffixes, generated strings, run metrics."""
