"""Column functions and the numerical helpers that tasks and the driver share."""
