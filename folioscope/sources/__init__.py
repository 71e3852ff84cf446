"""sources of folioscope."""
