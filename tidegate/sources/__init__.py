"""Reading and writing tables and message streams."""
