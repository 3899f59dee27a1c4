"""What queries read: repositories of source files."""
