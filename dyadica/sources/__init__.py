"""Readers and writers of trajectories."""
