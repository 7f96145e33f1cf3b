"""sievework: source-text, diagnostics and corpus analytics as Spark DataFrame jobs."""
