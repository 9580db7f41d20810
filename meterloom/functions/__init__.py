"""Column functions of the metering domain."""
