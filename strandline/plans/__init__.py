"""Plans that go beyond one query: versions of a set of sequences, background jobs."""
