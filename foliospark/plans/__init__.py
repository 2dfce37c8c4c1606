"""Ready-made jobs and the driver's queries."""
