"""Tables, annotation files and sinks."""
