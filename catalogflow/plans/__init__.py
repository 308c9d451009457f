"""Compositions of operators into the application's jobs, plus the stand-in
inputs derived from the driver tables that the registered checks use."""
