"""Event streams: file sources, duplicate suppression, micro-batch consolidation, resonance fields."""
