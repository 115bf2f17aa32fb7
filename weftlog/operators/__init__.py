"""operators of weftlog."""
