"""Stateful streaming form of the replay buffer."""
