"""Lead prospecting over Brazilian open company data, as Spark DataFrame jobs."""
