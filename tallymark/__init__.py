"""Decision-record curation, scoring analytics and event-log audits as PySpark DataFrame jobs."""
