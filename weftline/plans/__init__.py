"""Multi-step jobs that combine operators."""
