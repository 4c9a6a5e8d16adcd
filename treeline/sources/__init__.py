"""Tables, files and built-in trees."""
