"""Where samples, features and variables come from."""
