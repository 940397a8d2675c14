"""Column functions and the Arrow functions that SQL cannot express."""
