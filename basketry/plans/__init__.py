"""Query plans: cleaning (C), exploratory (E), business (B), marts (V) and
narrative metrics (R), each a function of ``Tables``."""
