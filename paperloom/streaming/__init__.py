"""Part of paperloom: streaming."""
