"""streaming of weftlog."""
