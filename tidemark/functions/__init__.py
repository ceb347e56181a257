"""functions of the event-study engine."""
