"""sources of weftlog."""
