"""Raw files in and out."""
