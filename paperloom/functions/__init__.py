"""Part of paperloom: functions."""
