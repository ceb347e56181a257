"""operators of the event-study engine."""
