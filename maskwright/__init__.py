"""maskwright: find, replace and audit personal data over a corpus with Spark."""
