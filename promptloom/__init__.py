"""Text-to-SQL corpora as Spark jobs: generate, score, corrupt, rewrite, profile, analyse."""
