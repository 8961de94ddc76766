"""Operators over points, trajectories, pathlets and clusters."""
