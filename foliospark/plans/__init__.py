"""From a question to a typed frame, and from a frame to a plan of operators."""
