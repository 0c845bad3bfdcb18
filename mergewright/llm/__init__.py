"""Training-data operators: thirteen of them, each in a module of its own, and their registered queries."""
