"""Query plans: strategies and explanations."""
