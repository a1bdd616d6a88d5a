"""streaming of pageloom."""
