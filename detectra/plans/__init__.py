"""The study façade and the registered query catalogue."""
