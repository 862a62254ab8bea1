"""The change feed: events about files, as a table or a stream, applied to the index."""
