"""sources of pageloom."""
