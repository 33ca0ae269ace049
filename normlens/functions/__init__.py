"""Column-level helpers (pure expressions, JVM-side unless noted)."""
