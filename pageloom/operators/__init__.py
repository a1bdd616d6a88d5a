"""operators of pageloom."""
