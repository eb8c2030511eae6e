"""Conversation-log analytics on Spark: turns, topics, pruning, compaction and budgeted context assembly."""
