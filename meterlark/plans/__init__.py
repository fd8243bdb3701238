"""Reports made of several operators."""
