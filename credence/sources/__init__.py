"""Knowledge bases, bound tables and the event log."""
