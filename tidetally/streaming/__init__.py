"""The refresh as a stream of landed files."""
