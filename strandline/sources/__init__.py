"""Reading and writing sequence formats."""
