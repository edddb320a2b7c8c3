"""Part of the policy analytics library."""
