"""Reading the event log and provider responses; writing exports."""
