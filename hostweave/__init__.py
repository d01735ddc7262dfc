"""Authentication-event analytics as DataFrame plans."""
