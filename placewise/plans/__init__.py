"""The five tasks: friendship, next place, trips, reviews, trajectories."""
