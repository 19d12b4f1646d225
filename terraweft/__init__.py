"""terraweft: survey-mapping analytics and training-data operators as Spark jobs."""
