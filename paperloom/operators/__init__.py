"""Part of paperloom: operators."""
