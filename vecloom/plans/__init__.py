"""Settings of quantizers and searches, and the bit planner."""
