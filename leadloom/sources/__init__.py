"""Tables, files and saved pages."""
