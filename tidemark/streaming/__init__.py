"""streaming of the event-study engine."""
