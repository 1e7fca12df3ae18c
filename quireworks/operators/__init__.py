"""Table jobs: functions of DataFrames that give DataFrames and run no action."""
