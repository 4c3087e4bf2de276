"""Basketball analytics on Spark: composable DataFrame operators over all leagues, teams and seasons at once."""
