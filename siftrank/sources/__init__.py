"""Readers and writers: text collections, topics, judgements, runs, ratings, index tables."""
