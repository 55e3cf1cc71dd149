"""SQL expressions over text, spans and tokens."""
