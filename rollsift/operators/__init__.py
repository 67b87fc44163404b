"""Relational operators over rollouts, samples and metrics."""
