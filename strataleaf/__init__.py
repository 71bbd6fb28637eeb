"""Document-structure analytics as DataFrame plans."""
