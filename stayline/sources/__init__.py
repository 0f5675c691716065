"""Reading raw tables and artifacts, and writing results."""
