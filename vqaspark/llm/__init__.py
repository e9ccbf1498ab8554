"""Training-data operators.  Modules are imported one by one, so a Python worker loads only what its stage needs."""
