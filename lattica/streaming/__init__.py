"""Statements that run in the background: progress, cancelling, time limits; and statements over streams."""
