"""Operators over streams, with their batch replays."""
