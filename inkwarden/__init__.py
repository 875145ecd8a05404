"""inkwarden: text-security scanning and its evaluation, expressed as Spark plans."""
