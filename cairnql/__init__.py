"""An analytics engine on Spark: typed tables, relational operators, views, DML, procedures, jobs and statistics."""
