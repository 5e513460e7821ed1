"""maskwright: sensitive-data detection, policy, masking and corpus tooling on Spark."""
