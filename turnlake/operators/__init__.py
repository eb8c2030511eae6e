"""Operators over typed lines, turns, topics and flat messages; every one serves all sessions at once."""
