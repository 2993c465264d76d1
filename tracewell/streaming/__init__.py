"""The library processes finite collections only; there is no streaming operator to offer."""
