"""Writers for the tables the jobs produce."""
