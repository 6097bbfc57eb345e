"""Column builders and the few Python functions that the engine's expressions can't replace."""
