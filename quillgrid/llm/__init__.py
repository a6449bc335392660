"""Operators for training-data pipelines: shards, chats, duplicates, tokens, search, scores."""
