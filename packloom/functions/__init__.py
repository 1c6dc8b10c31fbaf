"""packloom: functions."""
