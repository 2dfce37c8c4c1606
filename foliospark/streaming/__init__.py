"""Files as they arrive. The reference does not stream; extraction has no state, so it runs unchanged."""
