"""plans of weftlog."""
