"""An engine for data about code changes, their tests, and training text."""
