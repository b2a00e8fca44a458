"""Row-wise operators on Structured Streaming sources."""
