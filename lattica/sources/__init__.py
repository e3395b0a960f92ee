"""Tables: registration, loading of files, deployment descriptors, metadata and writing."""
