"""Change feeds: batch passes and Structured Streaming replays (ST-1 .. ST-7, SRC-6)."""
