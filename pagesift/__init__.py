"""pagesift: web-page extraction and wrapper induction as Spark DataFrame jobs."""
