"""Sources and sinks: the markdown tree reader, parsers of its file formats, and writers."""
