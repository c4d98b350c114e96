"""SQL gate and the registered queries."""
