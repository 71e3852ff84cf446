"""streaming of folioscope."""
