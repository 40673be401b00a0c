"""Tables in, tables out, and configurations."""
