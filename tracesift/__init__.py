"""Statistical fault localization, and what else a corpus of runs or texts needs, as Spark jobs."""
