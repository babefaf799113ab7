"""Tables, derived series, and simulated data."""
