"""skirmish: a PySpark-native engine for sequence, matchup and decision analytics."""
