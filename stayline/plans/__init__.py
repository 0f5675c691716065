"""The clinical study: fixed patterns, item lists and thresholds, and its stages."""
