"""Functions of the engine, as DataFrame transformations."""
