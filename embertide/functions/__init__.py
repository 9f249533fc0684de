"""Column functions: decay arithmetic, priorities, exact Python functions, answers."""
