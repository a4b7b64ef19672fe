"""Messages, rules and views: where they are read from and written to."""
