"""Part of paperloom: rules."""
