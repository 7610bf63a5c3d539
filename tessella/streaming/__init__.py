"""The row-local operators over streams."""
