"""Column expressions: null policy, rules, dates, encoders."""
