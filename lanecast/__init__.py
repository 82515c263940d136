"""lanecast: point-in-time analytics of priced contests on Spark DataFrames."""
