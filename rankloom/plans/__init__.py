"""Query plans composed of operators."""
