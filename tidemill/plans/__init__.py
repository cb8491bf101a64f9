"""DDL, INSERT and SELECT front-end."""
