"""stormgrid: storm-track and tsunami hazard analytics as Spark DataFrame plans."""
