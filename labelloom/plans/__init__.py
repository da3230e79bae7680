"""Multi-step jobs composed of the operators."""
