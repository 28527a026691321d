"""Runnable jobs: each file has a command line, a small JSON config beside it, and a function that takes a session."""
