"""Structured Streaming: the change feed as a source, outbox delivery, folds per address."""
