"""sources of the event-study engine."""
