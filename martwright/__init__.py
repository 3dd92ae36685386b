"""martwright: a Spark-first analyst mart with guarded SQL, voting, grounding and evaluation analytics."""
