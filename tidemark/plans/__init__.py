"""plans of the event-study engine."""
