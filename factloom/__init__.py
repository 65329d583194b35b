"""Financial-statement analytics and training-text preparation on Spark."""
