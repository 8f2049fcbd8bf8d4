"""Reading and writing tables, run results and drift reports."""
