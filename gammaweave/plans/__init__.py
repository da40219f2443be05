"""Settings, stores and iterative plans."""
