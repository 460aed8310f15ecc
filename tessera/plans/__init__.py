"""plans of the analytics library."""
