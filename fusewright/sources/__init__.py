"""Sources: each turns a DataFrame of raw input into source profiles (``schema.PROFILE``), with ``error`` set where it can't."""
