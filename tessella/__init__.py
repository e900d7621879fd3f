"""Field-record and document analytics as DataFrame -> DataFrame operators on Spark."""
