"""Section reports over workload exports, and the registered query catalog."""
