"""Part of paperloom: sources."""
