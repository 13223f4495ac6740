"""File-source incremental loads."""
