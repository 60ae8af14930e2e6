"""Named sources, readers and sinks."""
