"""Structured Streaming forms of the incremental operators; append-like sources only."""
