"""functions of weftlog."""
