"""Part of paperloom: plans."""
