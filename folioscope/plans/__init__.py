"""plans of folioscope."""
