"""Reports as a stream."""
