"""Configurations, experiment plans and the service that runs them."""
