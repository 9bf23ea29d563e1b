"""Query and catalog models, parsing, and the planner that chooses a cube."""
