"""Named SQL steps, step chains and the registered query catalogue."""
